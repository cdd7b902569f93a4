"""Problem 3: the curve, the choice of tables and whole files."""

import numpy as np
import pytest

from siltstone.operators.small_files import SmallFiles, hilbert_codes, newest_files
from siltstone.sources.tables import SCHEMAS


def test_curve_visits_every_point_by_single_steps():
    n = 16
    x, y = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
    codes = hilbert_codes(x, y, bits=4)
    assert sorted(codes.tolist()) == list(range(n * n))
    order = np.argsort(codes)
    steps = np.abs(np.diff(x[order])) + np.abs(np.diff(y[order]))
    assert set(steps.tolist()) == {1}


def test_newest_files(spark):
    rows = [
        (1, "a/x", "present", 5), (2, "./a//x", "present", None), (3, "a\\x", "removed", None), (4, "b/../a/y", "present", 7),
        (4, "b/../a/y", "present", 7), (5, None, "present", 1), (6, "z", "present", None),
    ]
    df = spark.createDataFrame(rows, "scan_no bigint, path string, seen_state string, file_size bigint")
    got = {r["file"]: (r["state"], r["known_size"]) for r in newest_files(df).collect()}
    assert got == {"a/x": ("removed", 5), "a/y": ("present", 7), "z": ("present", None)}


def tables(spark, records, catalog=None):
    catalog = catalog or sorted({(r[0], r[1], r[2]) for r in records})
    cat = spark.createDataFrame([(*c, f"p{c[1]}", 900) for c in catalog], "db_id bigint, table_id bigint, level int, path string, max_seq bigint")
    foot = spark.createDataFrame(
        [(i, f"p{c[1]}", "present", 10) for i, c in enumerate(catalog)],
        "scan_no bigint, path string, seen_state string, file_size bigint",
    )
    runs = spark.createDataFrame(records, SCHEMAS["run_records"])
    targets = spark.createDataFrame([(0, 1000, 100), (1, 2000, 50), (2, 4000, 5)], SCHEMAS["level_targets"])
    return SmallFiles(cat, foot, runs, targets)


def hot_store():
    hot = [(1, i % 40, 0, 0, bytearray(b"hot"), bytearray(b"v" * 20), 0, i + 1) for i in range(600)]
    rest = [(1, i % 40, 0, 0, bytearray(b"acct/%04d" % i), None, 1, i + 1000) for i in range(3000)]
    return hot + rest


def test_hot_key_nulls_and_repeats_stay_whole(spark, tmp_path):
    odd = [(2, 99, 1, 0, bytearray(b""), bytearray(b""), 0, 1), (2, 99, 1, None, None, None, None, None),
           (2, 98, None, 0, bytearray(b"k"), None, 0, 3)]
    gone = [(3, 7, 0, 0, bytearray(b"x"), None, 0, 1)]
    large = [(1, 500, 1, 0, bytearray(b"x"), None, 0, 1)]
    records = hot_store() + odd
    listed = sorted({(r[0], r[1], r[2] or 0) for r in records}) + [(1, 500, 2)]
    sf = tables(spark, records + records[:50] + gone + large, listed)
    out = {(r["db_id"], r["level"]): r for r in sf.run(f"file://{tmp_path}/o").collect()}
    assert out[1, 0]["n_rows"] == 3600 and out[2, 1]["n_rows"] == 2 and out[2, None]["n_rows"] == 1 and (3, 0) not in out
    assert all(r["whole"] for r in out.values()) and out[1, 2]["files_kept"] == 1
    assert 10 < out[1, 0]["files_after"] < 40 and out[2, 1]["files_after"] == 1
    assert out[1, 0]["files_before"] == 40 and out[1, 0]["file_bytes_max"] == max(
        f.stat().st_size for f in (tmp_path / "o/files/db_id=1/level=0").rglob("*.parquet"))
    # Balanced by record bytes: no file has more than twice its share.
    cat = [r for r in spark.read.parquet(f"file://{tmp_path}/o/catalog").collect() if r["db_id"] == 1 and r["level"] == 0]
    assert max(r["record_bytes"] for r in cat) <= 2 * sum(r["record_bytes"] for r in cat) / len(cat)
    # Compact in the keys: keys of one family share a prefix, and yet a file spans a part of them only.
    spans = [int(r["largest_key"][5:]) - int(r["smallest_key"][5:]) for r in cat if bytes(r["smallest_key"]) > b"acct" and bytes(r["largest_key"]) < b"b"]
    assert spans and max(spans) < 2500


def test_groups_in_several_passes(spark):
    records = hot_store() + [(d, 50 + i % 3, 0, 0, bytearray(b"k%d" % i), None, 0, i) for d in range(2, 8) for i in range(60)]
    one, many = tables(spark, records), tables(spark, records)
    many.layout_bytes = 3000
    rows = [{tuple(r[:4]) for r in sf.run().collect()} for sf in (one, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 7


def test_lost_rows_are_noticed_and_nothing_is_published(spark, tmp_path):
    class Lossy(SmallFiles):
        def _rewrite(self, staged, table, path):
            super()._rewrite(staged.where("seq_num <> 17"), table, path)

    sf = tables(spark, hot_store())
    with pytest.raises(RuntimeError):
        Lossy(sf.catalog, sf.footers, sf.run_records, sf.targets).run(f"file://{tmp_path}/o")
    assert not list(tmp_path.glob("o/version-*")) and not (tmp_path / "o/files").exists()


def test_small_tables(spark):
    sf = tables(spark, [(1, 1, 0, 0, bytearray(b"a"), None, 0, 1), (1, 2, 2, 0, bytearray(b"a"), None, 0, 1)])
    assert [(r["db_id"], r["table_id"]) for r in sf.small_tables().collect()] == [(1, 1)]


def test_empty(spark):
    sf = tables(spark, [])
    assert sf.small_tables().count() == 0 and sf.records().count() == 0 and sf.run().count() == 0
