"""Problem 4: orphan references against a model."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.operators import references
from siltstone.operators.references import _Range, orphan_counts, orphan_rows, orphans
from siltstone.sources.tables import SCHEMAS

REF, PAR = "_key string, _at bigint, payload string", "_key string, _at bigint, _alive boolean"


def model(refs, parents):
    out = set()
    for key, at, payload in refs:
        if key is None or at is None:
            continue
        events = {}
        for k, t, alive in parents:
            if k == key and t is not None:
                events[t] = events.get(t, True) and alive
        before = [t for t in events if t <= at]
        if not events:
            out.add((key, at, payload, "missing"))
        elif not before:
            out.add((key, at, payload, "later"))
        elif not events[max(before)]:
            out.add((key, at, payload, "deleted"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 5 + [f"k{i}" for i in range(60)] + ["", "é", None])
    refs = [(key(), rnd.choice([None, *range(20)]), str(i % 7)) for i in range(800)]
    parents = [(key(), rnd.randrange(20), rnd.random() < 0.6) for _ in range(90)]
    parents += parents[:20]
    got = orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)).collect()
    assert {(r["_key"], r["_at"], r["payload"], r["reason"]) for r in got} == model(refs, parents)


def test_empty_sides(spark):
    refs, parents = spark.createDataFrame([("a", 1, "x")], REF), spark.createDataFrame([("a", 1, True)], PAR)
    assert orphans(refs.limit(0), parents).count() == 0
    assert [r["reason"] for r in orphans(refs, parents.limit(0)).collect()] == ["missing"]


def test_extra_columns_with_clashing_names(spark):
    refs = spark.createDataFrame([("a", 1, "x", 5)], "_key string, _at bigint, reason string, _side int")
    parents = spark.createDataFrame([("b", 1, True, "y")], PAR + ", _side string")
    assert [r["reason"] for r in orphans(refs, parents).collect()] == ["missing"]


def test_keys_of_one_hash_are_told_apart():
    rows = [(5, "a", 1, True), (5, "b", 2, True), (5, "c", 0, True), (5, "c", 3, False), (9, "d", 1, True)]
    parents = pa.table({"_h": [r[0] for r in rows], "_key": [r[1] for r in rows], "_at": [r[2] for r in rows], "_alive": [r[3] for r in rows]})
    asked = [(5, "a", 1), (5, "b", 1), (5, "c", 2), (5, "c", 3), (5, "x", 9), (9, "d", 5), (9, "a", 5), (1, "a", 5), (10, "z", 1)]
    got = _Range(parents).probe(
        np.array([r[0] for r in asked]), pa.array([r[1] for r in asked], pa.large_string()), np.array([r[2] for r in asked])
    )
    assert got.tolist() == ["found", "later", "found", "deleted", "missing", "found", "missing", "missing", "missing"]


def test_ranges_follow_the_number_of_parents(spark, monkeypatch):
    monkeypatch.setattr(references, "RANGE_ROWS", 10)
    refs = spark.range(300).selectExpr("cast(id as string) as _key", "1L as _at")
    parents = spark.range(0, 300, 2).selectExpr("cast(id as string) as _key", "0L as _at", "true as _alive")
    sizes = []
    real = references.written
    monkeypatch.setattr(references, "written", lambda df, name: sizes.append(df.rdd.getNumPartitions()) or real(df, name))
    assert {int(r["_key"]) % 2 for r in orphans(refs, parents).collect()} == {1} and sizes == [15]


def edits(spark, rows):
    full = [(db, no, op, t, level, *[None] * 13, state, None) for db, no, op, t, level, state in rows]
    return spark.createDataFrame(full, SCHEMAS["manifest_edits"])


def empty(spark, name):
    return spark.createDataFrame([], SCHEMAS[name])


def test_deletes_first_and_levels(spark):
    rows = [
        (1, 1, "add", 7, 0, "synced"), (1, 2, "delete", 7, 0, "synced"), (1, 2, "add", 7, 1, "synced"),
        (1, 3, "delete", 7, 0, "synced"),  # live at level 1 only
        (1, 4, "delete", 8, 0, "synced"), (1, 4, "add", 8, 0, "synced"),  # deletes come first
        (1, 5, "delete", 8, 0, "synced"), (1, 5, "delete", 8, 0, "synced"), (1, 6, "delete", 8, 0, "torn"),
        (1, 7, "delete", 7, 1, "failed"), (2, 2, "delete", 7, 1, "synced"),
    ]
    got = orphan_rows(edits(spark, rows), empty(spark, "table_meta"), empty(spark, "sst_footers")).collect()
    assert {(r["db_id"], r["edit_no"], r["table_id"]) for r in got} == {(1, 3, 7), (1, 4, 8), (2, 2, 7)}


def test_counts_have_a_null_month(spark):
    rows = [(1, 4, "delete", 8, 0, "synced"), (1, 5, "delete", 9, 0, "synced")]
    got = orphan_counts(edits(spark, rows), empty(spark, "table_meta"), empty(spark, "sst_footers")).collect()
    assert [(r["referring_table"], r["month"], r["n_orphans"]) for r in got] == [("manifest_edits", None, 2)]


def test_counts_tell_levels_paths_and_repeats_apart(spark):
    rows = [
        (1, 1, "add", 7, 0, "synced"), (1, 2, "delete", 7, 0, "synced"), (1, 2, "delete", 7, 0, "synced"),
        (1, 3, "delete", 8, 0, "synced"), (1, 3, "delete", 8, 1, "synced"),  # two levels
    ]
    times = [None, None, dt.datetime(2024, 1, 1), *[None] * 2]
    # Table 7 is live: of three differing deletes the earliest takes effect. Table 9 is not: all three are orphans.
    rows += [(1, 2, "delete", 7, 0, "synced"), *[(1, 4, "delete", 9, 0, "synced")] * 3]
    times += [dt.datetime(2024, 1, 2), None, dt.datetime(2024, 1, 3), dt.datetime(2024, 2, 3)]
    full = [(db, no, op, t, level, *[None] * 13, state, at) for (db, no, op, t, level, state), at in zip(rows, times, strict=True)]
    meta = [(1, 5, 0, p, *[None] * 9, 1, None) for p in ("x", "./x", "y")]
    got = orphan_counts(
        spark.createDataFrame(full, SCHEMAS["manifest_edits"]), spark.createDataFrame(meta, SCHEMAS["table_meta"]),
        empty(spark, "sst_footers"),
    ).collect()
    assert {(r["ref_kind"], r["month"]): r["n_orphans"] for r in got} == {
        ("deleted_table", None): 4, ("deleted_table", "2024-01"): 2, ("deleted_table", "2024-02"): 1, ("table_path", None): 2,
    }
