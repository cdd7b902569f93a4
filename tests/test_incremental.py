"""Problem 2: frontiers, new records and published targets."""

import pytest

from siltstone.operators.incremental import IncrementalTarget, new_records, read_frontier, split_log
from siltstone.plans.queries import QUERIES
from siltstone.sources.tables import SCHEMAS

EDIT = "db_id bigint, op string, commit_state string, current_wal_id bigint, next_sequence_number bigint"
HEAD = "db_id bigint, wal_id bigint, start_seq bigint, version int"
ROW = "db_id bigint, key_entry string, seq_num bigint, extra string"
ID = ["db_id", "key_entry", "seq_num"]


def frontier(spark, edits, heads):
    out = read_frontier(spark.createDataFrame(edits, EDIT), spark.createDataFrame(heads, HEAD))
    return {r["db_id"]: r["frontier"] for r in out.collect()}


def test_frontier(spark):
    edits = [
        (1, "counter", "synced", 5, None), (1, "counter", "synced", 3, 9),  # a counter that went back
        (2, "counter", "synced", None, 100), (3, "counter", "synced", None, 7), (4, "counter", "failed", 9, None),
        (5, "counter", "synced", None, None), (6, "add", "synced", 4, None), (7, "counter", "synced", 1, 50),
    ]
    heads = [(2, 4, 100, 1), (2, 8, 100, 0), (3, 2, 8, 1), (7, 9, 50, 1), (2, 4, 100, 1)]
    assert frontier(spark, edits, heads) == {1: 5, 2: 4, 7: 1}


def test_empty(spark):
    assert frontier(spark, [], []) == {}
    log = spark.createDataFrame([], SCHEMAS["changelog"])
    out = split_log(log, spark.createDataFrame([], EDIT), spark.createDataFrame([], HEAD))
    assert out.count() == 0


def test_split_without_frontier_has_read_nothing(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, bytearray(b"k"), None, 0, 1, None), (2, 1, None, bytearray(b"k"), None, 0, 2, None)],
        SCHEMAS["changelog"],
    )
    rows = split_log(log, spark.createDataFrame([], EDIT), spark.createDataFrame([], HEAD)).collect()
    assert [(r["log_no"], r["was_read"]) for r in rows] == [(1, False)]


def test_new_records_once_and_null_safe(spark):
    src = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 1, "y"), (1, None, 2, ""), (1, "", 3, ""), (2, "a", 1, "")], ROW)
    have = spark.createDataFrame([(1, None, 2, ""), (2, "a", 2, "")], ROW)
    got = {tuple(r) for r in new_records(src, have, ID).collect()}
    assert got == {(1, "a", 1), (1, "", 3), (2, "a", 1)}
    assert new_records(src.limit(0), have, ID).count() == 0
    assert new_records(src, have.limit(0), ID).count() == 4


def test_target_processes_each_record_once(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/t", ID)
    assert t.read() is None
    one = spark.createDataFrame([(1, "a", 1, ""), (1, "b", 2, "")], ROW)
    assert t.run(one)[1].count() == 2
    both = one.unionByName(spark.createDataFrame([(1, "a", 3, "")], ROW))
    assert [tuple(r) for r in t.run(both)[1].collect()] == [(1, "a", 3)]
    assert t.run(both)[1].count() == 0
    assert t.version() == 3 and t.read().count() == 3 and t.read(1).count() == 2


def test_failed_run_leaves_no_trace(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/t", ID)
    src = spark.createDataFrame([(1, "a", 1, "")], ROW)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.run(src, broken)
    assert t.version() == 0 and t.run(src)[1].count() == 1


def test_second_writer_of_a_version_fails(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/t", ID)
    src = spark.createDataFrame([(1, "a", 1, "")], ROW)

    def meanwhile(df):
        IncrementalTarget(spark, f"file://{tmp_path}/t", ID).run(src)
        return df

    with pytest.raises(RuntimeError):
        t.run(src, meanwhile)
    assert t.version() == 1 and t.read().count() == 1


def test_clashing_columns_are_replaced(spark):
    log = spark.createDataFrame(
        [(1, 1, bytearray(b"k"), 0, 1, "x", True)],
        "db_id bigint, wal_id bigint, key_entry binary, type int, seq_num bigint, frontier string, was_read boolean",
    )
    rows = split_log(log, spark.createDataFrame([], EDIT), spark.createDataFrame([], HEAD)).collect()
    assert [r["was_read"] for r in rows] == [False]


def test_found_publishes_its_rows(spark, data, tmp_path, monkeypatch):
    """p2_found's rows are those that version 2 of a published target adds."""
    monkeypatch.setattr("siltstone.plans.queries.scratch", lambda _, name: f"file://{tmp_path}/{name}-x")
    n = QUERIES["p2_found"](spark, data).count()
    assert [p.name for p in sorted(tmp_path.glob("incremental-*/version-*.json"))] == ["version-1.json", "version-2.json"]
    (added,) = tmp_path.glob("incremental-*/rows-2-*")
    assert spark.read.parquet(f"file://{added}").distinct().count() == n > 0


def test_run_killed_before_publishing_is_repeated_with_the_same_rows(spark, tmp_path, monkeypatch):
    t = IncrementalTarget(spark, f"file://{tmp_path}/t", ID)
    one = spark.createDataFrame([(1, "a", 1, ""), (1, "b", 2, "")], ROW)
    both = one.unionByName(spark.createDataFrame([(1, "a", 3, ""), (2, None, 1, "")], ROW))
    t.run(one)

    def killed(version, state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(t._folder, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            t.run(both)
    assert t.version() == 1 and len(list(tmp_path.glob("t/rows-2-*"))) == 1  # written, never published
    again = IncrementalTarget(spark, f"file://{tmp_path}/t", ID)
    assert {tuple(r) for r in again.run(both)[1].collect()} == {(1, "a", 3), (2, None, 1)}
    assert len(again.clean()) == 1 and again.read().count() == 4 and len(list(tmp_path.glob("t/rows-2-*"))) == 1


def test_folders_of_a_version_stay_few(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/t", ID, max_folders=3)
    for n in range(1, 8):
        version, added = t.run(spark.createDataFrame([(1, "a", i, "") for i in range(n)], ROW))
        assert version == n and [r["seq_num"] for r in added.collect()] == [n - 1]
        assert len(t._folder.state()["folders"]) <= 4
    t.clean()
    assert sorted(r["seq_num"] for r in t.read().collect()) == list(range(7))
    assert len(list(tmp_path.glob("t/version-*"))) == 2
