"""Store, stream, log, compaction and expressions."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from siltstone.functions.expressions import bloom_slots, normal_path
from siltstone.functions.joins import join_small
from siltstone.operators import catalog, checks, compaction, resolve, wal
from siltstone.operators.runs import bloom_build, bloom_probe, pack_blocks, split_outputs
from siltstone.sources.tables import SCHEMAS
from siltstone.store import Store, UseAfterClose
from siltstone.streaming.upsert import LatestState, read_log


def test_store_against_a_model(spark, tmp_path):
    rnd, want = random.Random(0x5EED), {}
    s = Store.open(spark, f"file://{tmp_path}/s")
    for n in range(240):
        k = b"key-%d" % rnd.randrange(25) if n else b""
        if rnd.random() < 0.2:
            s.remove(k)
            want.pop(k, None)
        else:
            v = b"" if n % 17 == 0 else b"v%d" % n
            s.put(k, v)
            want[k] = v
        if n in (60, 150):
            s.flush()
    got = {bytes(r[0]): bytes(r[1]) for r in s.scan(b"", b"\xff").collect()}
    assert got == want
    s.compact_range()
    some = [*list(want)[:3], b"missing"]
    assert [s.get(k) for k in some] == [want.get(k) for k in some]
    s.close()
    s.close()
    with pytest.raises(UseAfterClose):
        s.get(b"x")
    again = Store.open(spark, f"file://{tmp_path}/s")
    assert {bytes(r[0]) for r in again.scan(b"", b"\xff").collect()} == set(want)
    assert again.put(b"next", b"1") > 240


def test_store_batch_keeps_the_declared_order(spark, tmp_path):
    s = Store.open(spark, f"file://{tmp_path}/s")
    rows = spark.range(1000).select(
        F.col("id").alias("no"), F.encode(F.concat(F.lit("k"), F.col("id") % 50), "UTF-8").alias("key_entry"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("value_entry"), F.lit(0).alias("type"),
    )
    s.write(rows.repartition(5), ["no"])
    assert s.get(b"k7") == b"957" and s.records().select("seq_num").distinct().count() == 1000


def test_stream_settles_late_and_repeated_batches(spark, data, tmp_path):
    log = spark.read.schema(SCHEMAS["changelog"]).parquet(f"{data}/changelog.parquet")
    (tmp_path / "in").mkdir()
    for i, part in enumerate(log.randomSplit([0.4, 0.4, 0.2], 3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/p{i}")
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
    state = LatestState(spark, f"file://{tmp_path}/state")
    for _ in range(2):  # the second start finds nothing new
        state.start(read_log(spark, str(tmp_path / "in"), 1), str(tmp_path / "ck")).awaitTermination()
    state.apply(log.limit(10), 0)  # a batch run again
    want = resolve.latest_view(log, tie=[-F.col("log_no")])
    cols = ["db_id", "key_entry", "seq_num", "type"]
    assert {tuple(map(str, r)) for r in state.read().select(cols).collect()} == {tuple(map(str, r)) for r in want.select(cols).collect()}


def records(spark, rows):
    return spark.createDataFrame(
        [(1, 1, s, k, bytearray(key), None if v is None else bytearray(v), 0) for s, k, key, v in rows],
        "db_id bigint, wal_id bigint, seq_num bigint, type int, key_entry binary, value_entry binary, log_no int",
    )


def test_log_round_trip_over_blocks(spark):
    rows = [(i + 1, i % 2, b"k%d" % i, b"v" * (i * 7 % 300)) for i in range(80)] + [(99, 0, b"", None)]
    frags = wal.to_fragments(records(spark, rows), ["seq_num"], block_bytes=128).collect()
    assert {f["frag_type"] for f in frags} == {wal.FULL, wal.FIRST, wal.MIDDLE, wal.LAST}
    assert all(f["offset"] // 128 == (f["offset"] + wal.FRAGMENT_HEADER_BYTES + len(f["payload"]) - 1) // 128 for f in frags)
    back = wal.to_records(spark.createDataFrame(frags)).collect()
    assert {(r["seq_num"], bytes(r["key_entry"]), bytes(r["value_entry"])) for r in back} == {(s, k, v or b"") for s, _, k, v in rows}


def test_log_damage(spark):
    frags = wal.to_fragments(records(spark, [(1, 0, b"a", b"x" * 200), (2, 0, b"b", b"y" * 200)]), ["seq_num"], 128).collect()
    one, two = [f for f in frags if f["seq_num"] == 1], [f for f in frags if f["seq_num"] == 2]
    got = lambda fs: [(r["seq_num"], r["corruption"]) for r in wal.to_records(spark.createDataFrame(fs)).collect()]
    assert got(one + two[:-1]) == [(1, None)]  # a torn tail
    assert (1, "unfinished") in got(one[:-1] + two)
    assert (1, "no_beginning") in got(one[1:] + two)
    assert (1, "mixed") in got([*one[:1], *two[1:]])


OPT = compaction.CompactionOptions(max_levels=3, l0_trigger=2, level_limits=(100,), target_sizes=(8, 10, 20))


def cat(spark, rows):
    full = [(1, t, lv, None, 1, 2, size, 1, 0, 1, 1, bytearray(lo), bytearray(hi), 1, None) for t, lv, lo, hi, size in rows]
    return spark.createDataFrame(full, SCHEMAS["table_meta"])


def test_compaction_choice(spark):
    plan = lambda rows: {(r["table_id"], r["role"]) for r in compaction.plan(cat(spark, rows), OPT).collect()}
    l0 = [(1, 0, b"d", b"h", 1), (2, 0, b"a", b"e", 1), (3, 1, b"c", b"f", 1), (4, 1, b"x", b"z", 1)]
    assert plan(l0) == {(1, "source"), (2, "source"), (3, "overlap")}
    assert plan([(10, 1, b"a", b"c", 60), (11, 1, b"d", b"f", 70)]) == {(11, "source")}
    assert plan([(10, 1, b"a", b"c", 50), (11, 1, b"d", b"f", 50)]) == set()
    assert plan([(10, 1, b"a", b"c", 60), (11, 1, b"d", b"f", 60)]) == {(10, "source")}
    assert plan([(1, 0, b"a", b"b", 9)]) == set()
    assert plan([(5, 2, b"a", b"b", 10**9), (6, 2, b"c", b"d", 10**9)]) == set()


@pytest.mark.parametrize("bad", [{"max_levels": 1}, {"l0_trigger": 0}, {"level_limits": ()}, {"target_sizes": (1,)}, {"level_limits": (0,)}])
def test_compaction_options(bad):
    with pytest.raises(ValueError):
        compaction.CompactionOptions(**({"max_levels": 3, "level_limits": (1,), "target_sizes": (1, 1, 1)} | bad))


def test_tombstones_go_only_at_the_bottom(spark):
    rows = [(1, 1, 0, 0, bytearray(b"a"), None, 1, 9), (1, 2, 0, 0, bytearray(b"a"), bytearray(b"x"), 0, 4)]
    runs = spark.createDataFrame(rows, SCHEMAS["run_records"])
    assert compaction.merge(runs).count() == 1 and compaction.merge(runs, bottommost=True).count() == 0


def test_equal_sequences_across_runs(spark):
    rows = [(1, 1, 0, 0, bytearray(b"a"), bytearray(b"l0"), 0, 4), (1, 2, 1, 0, bytearray(b"a"), bytearray(b"l1"), 0, 4),
            (1, 3, 0, 0, bytearray(b"a"), bytearray(b"newer"), 0, 4)]
    assert bytes(compaction.merge(spark.createDataFrame(rows, SCHEMAS["run_records"])).collect()[0]["value_entry"]) == b"newer"


def test_violations(spark):
    c = cat(spark, [(1, 1, b"a", b"f", 9), (2, 1, b"f", b"z", 9), (3, 0, b"z", b"a", 9), (4, 0, b"a", b"b", 0), (0, 0, b"a", b"b", 9),
                    (5, 9, b"a", b"b", 9), (6, 3, b"a", b"b", 9), (6, 4, b"a", b"b", 9)])
    edits = spark.createDataFrame([], SCHEMAS["manifest_edits"])
    assert {(r[1], r[2]) for r in catalog.violations(c, edits).collect()} == {
        (2, "level_overlap"), (3, "bad_range"), (4, "bad_size"), (0, "reserved_id"), (5, "no_such_level"), (6, "repeated_id"),
    }


def test_overlap_with_an_earlier_wide_table(spark):
    c = cat(spark, [(1, 1, b"a", b"z", 9), (2, 1, b"b", b"c", 9), (3, 1, b"d", b"e", 9)])
    got = catalog.violations(c, spark.createDataFrame([], SCHEMAS["manifest_edits"])).collect()
    assert {(r[1], r[2]) for r in got} == {(2, "level_overlap"), (3, "level_overlap")}


def edit_rows(spark, rows):
    """(edit_no, op, table_id, next_table_id, next_sequence_number, current_wal_id, commit_state)"""
    full = [(1, n, op, t, None, *[None] * 10, a, b, c, state, None) for n, op, t, a, b, c, state in rows]
    return spark.createDataFrame(full, SCHEMAS["manifest_edits"])


def test_counter_rules(spark):
    rows = [
        (1, "counter", None, 5, 10, 1, "synced"), (2, "add", 7, None, None, None, "synced"), (2, "counter", None, 7, 9, 0, "synced"),
        (3, "counter", None, 9, 10, None, "synced"), (3, "counter", None, 9, 10, None, "synced"), (4, "counter", None, 1, 1, 1, "failed"),
    ]
    got = {tuple(r)[1:] for r in catalog.counter_violations(edit_rows(spark, rows)).collect()}
    assert got == {
        (2, "next_table_id", 7, "not_above_tables"), (2, "next_sequence_number", 9, "regressed"),
        (2, "current_wal_id", 0, "zero"), (2, "current_wal_id", 0, "regressed"),
    }


def test_recovery_of_the_edit_log(spark):
    rows = [(n, "add", n, None, None, None, s) for n, s in enumerate(["synced", "torn", "failed", "synced", "torn"], 1)]
    assert [tuple(r) for r in catalog.recovery(edit_rows(spark, rows)).collect()] == [(1, 4, 1, 1, 1)]


def test_add_rules(spark):
    live = cat(spark, [(1, 1, b"d", b"f", 9), (2, 1, b"m", b"p", 9), (3, 0, b"a", b"z", 9)])
    adds = [(10, 1, b"a", b"c"), (11, 1, b"f", b"g"), (12, 1, b"a", b"d"), (13, 1, b"l", b"q"), (14, 1, b"n", b"o"), (15, 0, b"a", b"z"),
            (0, 0, b"a", b"b"), (16, 7, b"a", b"b"), (17, 2, b"c", b"b"), (3, 2, b"a", b"b"), (18, 3, b"a", b"c"), (19, 3, b"c", b"e")]
    got = checks.add_violations(cat(spark, [(*a, 1) for a in adds]), live).collect()
    assert {(r["table_id"], r["rule"]) for r in got} == {
        *((t, "overlap") for t in (10, 11, 12, 13, 14, 18, 19)), (0, "reserved_id"), (16, "no_such_level"), (17, "bad_range"), (3, "known_id"),
    }


def test_remove_rules(spark):
    live = cat(spark, [(1, 1, b"d", b"f", 9), (2, 0, b"m", b"p", 9), (4, 0, b"m", b"p", 9)])
    asked = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 0), (1, 0, 0), (2, 1, 1), (1, 4, 0), (1, 4, None)], "db_id bigint, table_id bigint, level int")
    got = {tuple(r) for r in checks.remove_violations(asked, live).collect()}
    assert got == {(1, 2, 1, "wrong_level"), (1, 3, 0, "not_found"), (1, 0, 0, "reserved_id"), (2, 1, 1, "not_found"), (1, 4, 0, "repeated"), (1, 4, None, "repeated")}


def test_planted_faults_of_plans(spark):
    c = cat(spark, [(1, 0, b"a", b"b", 1), (2, 0, b"c", b"b", 1), (3, 1, b"a", b"b", 1)])
    plan = lambda rows: spark.createDataFrame(rows, "db_id bigint, source_level int, table_id bigint, level int, role string")
    rules = lambda rows: {r["rule"] for r in compaction.plan_violations(plan(rows), c, OPT).collect()}
    good = [(1, 0, 1, 0, "source"), (1, 0, 3, 1, "overlap")]
    assert rules(good) == set()
    assert rules(good[1:]) == {"no_source"} and rules(good + good[:1]) == {"repeated_table"}
    assert rules([*good, (1, 0, 2, 0, "source")]) == {"bad_range"} and rules([*good, (1, 0, 0, 0, "source")]) == {"reserved_id"}
    assert rules([*good, (1, 0, 9, 1, "source")]) == {"wrong_level"} and rules([(1, 2, 1, 2, "source")]) == {"last_level"}
    live = plan(good[:1]).select("db_id", "table_id", "level")
    assert [r["table_id"] for r in compaction.stale_inputs(plan(good), live).collect()] == [3]


def test_planted_order_faults(spark):
    row = lambda block, key, seq: (1, 1, 0, block, bytearray(key), None, 0, seq)
    out = lambda rows: [tuple(r)[2:] for r in checks.order_violations(spark.createDataFrame(rows, SCHEMAS["run_records"])).orderBy("block_no").collect()]
    assert out([row(0, b"a", 9), row(0, b"b", 5), row(1, b"b", 4), row(2, b"c", 1)]) == []
    assert out([row(0, b"b", 9), row(1, b"a", 9), row(2, b"c", 1)]) == [(1, True, 0)]
    assert out([row(0, b"a", 4), row(1, b"a", 9)]) == [(1, True, 0)]  # newest first
    assert out([row(0, b"a", 4), row(0, b"a", 4)]) == [(0, False, 1)]


def test_compaction_job_commits_or_refuses(spark, tmp_path):
    c = cat(spark, [(1, 0, b"a", b"m", 1), (2, 0, b"a", b"m", 1)])
    keys = [b"%c%d" % (97 + i % 13, i) for i in range(60)]
    runs = spark.createDataFrame(
        [(1, 1 + i % 2, 0, 0, bytearray(k), bytearray(b"v" * 30), int(i % 10 == 0), i + 1) for i, k in enumerate(keys)], SCHEMAS["run_records"]
    )
    adds = [(n, "add", t, None, None, None, "synced") for n, t in ((1, 1), (2, 2))]
    edits = edit_rows(spark, adds).fillna({"level": 0})
    options = compaction.CompactionOptions(max_levels=3, l0_trigger=2, level_limits=(100,), target_sizes=(500, 500, 500))
    done = compaction.run(runs, c, edits, options, f"file://{tmp_path}/out")
    rows = done.edit.orderBy("op", "table_id").collect()
    assert [(r["op"], r["table_id"], r["level"]) for r in rows if r["op"] == "delete"] == [("delete", 1, 0), ("delete", 2, 0)]
    added = [r for r in rows if r["op"] == "add"]
    assert [r["table_id"] for r in added] == list(range(3, 3 + len(added))) and len(added) > 3
    assert sum(r["record_count"] for r in added) == 54 and {r["edit_no"] for r in rows} == {3}
    assert all(bytes(a["largest_key"]) < bytes(b["smallest_key"]) for a, b in zip(added, added[1:], strict=False))
    assert all(500 <= r["data_bytes"] < 600 for r in added[:-1])
    assert [r["next_table_id"] for r in rows if r["op"] == "counter"] == [3 + len(added)]
    # Appended to the log, the same plan is stale and nothing is written.
    cols = [f.split()[0] for f in SCHEMAS["manifest_edits"].split(", ")]
    after = edits.select(*cols).unionByName(done.edit.select(*[x for x in cols if x in done.edit.columns]), allowMissingColumns=True)
    with pytest.raises(RuntimeError):
        compaction.run(runs, c, after, options, f"file://{tmp_path}/twice")
    assert not (tmp_path / "twice").exists()
    assert {r["table_id"] for r in catalog.replay(after).collect()} == {r["table_id"] for r in added}


def test_log_damage_of_fragments(spark):
    frags = wal.to_fragments(records(spark, [(i + 1, 0, b"k%d" % i, b"x" * 200) for i in range(6)]), ["seq_num"], 128)
    third = F.col("seq_num") == 3
    flipped = frags.withColumn("payload", F.when(third & (F.col("frag_no") == 1), F.encode(F.lit("y" * 106), "UTF-8")).otherwise(F.col("payload")))
    got = lambda df, **k: sorted((r["seq_num"], r["corruption"]) for r in wal.to_records(df, **k).collect())
    assert got(flipped) == [(1, None), (2, None), (3, "bad_checksum")]
    assert got(flipped, stop=False) == [(n, "bad_checksum" if n == 3 else None) for n in range(1, 7)]
    heads = spark.createDataFrame([(1, 1, 0)], "db_id bigint, wal_id bigint, version int")
    assert [(r["seq_num"], r["corruption"]) for r in wal.to_records(frags, heads).collect()] == [(None, "bad_header")]
    good = heads.withColumn("version", F.lit(1))
    assert len(got(frags, headers=good)) == 6


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    state = LatestState(spark, f"file://{tmp_path}/s", buckets=8)
    row = lambda n, key, seq: (n, 1, 1, bytearray(key), bytearray(b"v"), 0, seq, None)
    batch = lambda rows: spark.createDataFrame(rows, SCHEMAS["changelog"])
    state.apply(batch([row(i, b"k%d" % i, 1) for i in range(50)]), 0)
    before = state._folder.state()["folders"]
    state.apply(batch([row(99, b"k7", 5)]), 1)
    after = state._folder.state()["folders"]
    assert len(before) == len(after) == 8 and sum(before[b] != after[b] for b in after) == 1
    assert state.read().count() == 50 and {r["seq_num"] for r in state.read().where("log_no = 99").collect()} == {5}
    state.apply(batch([]), 2)
    assert LatestState(spark, f"file://{tmp_path}/s").buckets == 8 and state.read().count() == 50


def test_packing_rules(spark):
    rows = [(1, 1, 0, 0, bytearray(b"k%02d" % i), bytearray(b"v" * n), 0, 1) for i, n in enumerate([30, 30, 5000, 30, 10])]
    out = pack_blocks(spark.createDataFrame(rows, SCHEMAS["run_records"]), block_bytes=9 + 2 * 58).orderBy("key_entry").collect()
    assert [r["packed_block"] for r in out] == [0, 0, -1, 1, 1]
    same = [(1, 1, 0, 0, bytearray(b"a" if i < 3 else b"b"), bytearray(b"v" * 50), 0, i + 1) for i in range(5)]
    out = split_outputs(spark.createDataFrame(same, SCHEMAS["run_records"]), 100).collect()
    assert {(bytes(r["key_entry"]), r["file_no"]) for r in out} == {(b"a", 0), (b"b", 1)}


def full_slots(key):
    mask = 2**64 - 1

    def fnv(seed):
        h = 14695981039346656037 ^ seed
        for b in key:
            h = (h ^ b) * 1099511628211 & mask
        return h

    a, b = fnv(0x9E3779B97F4A7C15), fnv(0xC2B2AE3D27D4EB4F)
    return [a % 128, (a + b & mask) % 128]


def test_bloom_slots(spark):
    rnd = random.Random(5)
    keys = [b"", b"\x00", b"\xff\x80", b"a\nb", *(rnd.randbytes(rnd.randrange(20)) for _ in range(400))]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select("k", bloom_slots("k").alias("s"))
    assert all(r["s"] == full_slots(bytes(r["k"])) for r in df.collect())


def test_bloom_has_no_false_negatives(spark):
    runs = spark.createDataFrame([(1, 1, 0, 0, bytearray(b"k%d" % i), None, 0, 1) for i in range(40)], SCHEMAS["run_records"])
    slots = bloom_build(runs).collect()[0]["slots"]
    mask = bytearray(128)
    for s in slots:
        mask[s] = 1
    for extra, want in ((mask, True), (bytearray(128), False), (None, True), (bytearray(b"\x02" * 128), True)):
        sec = spark.createDataFrame([(1, 1, 128, 2, 40, extra)], SCHEMAS["bloom_sections"])
        assert bloom_probe(sec, b"k7").collect()[0]["may_contain"] is want


def test_paths(spark):
    cases = {"a/b": "a/b", "./a//b/": "a/b", "a\\.\\b": "a/b", "x/../a/b": "a/b", "../a": "a", "": "", "a..b/.c": "a..b/.c", "A/b ": "A/b "}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "p string").select("p", normal_path("p").alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == cases | {None: None}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_join_small_broadcasts_only_within_its_bound(spark, how, kind):
    big = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(200)], "k int, v int").withColumn("k", F.col("k").cast(kind))
    small = spark.createDataFrame([(0, 1), (1, 2), (7, 3)], "k int, w int").withColumn("k", F.col("k").cast(kind))
    want = sorted(map(str, big.join(small, ["k"], how).collect()))
    for most, broadcast in ((1 << 20, True), (50, False)):
        got = join_small(big, small, ["k"], how, max_bytes=most)
        assert sorted(map(str, got.collect())) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastExchange" in plan) == broadcast and ("SortMergeJoin" in plan) != broadcast
        assert "Generate" not in plan


def test_join_small_refuses_clashing_columns(spark):
    with pytest.raises(ValueError):
        join_small(spark.range(3).withColumn("x", F.lit(1)), spark.range(3).withColumn("x", F.lit(1)), ["id"])


def test_reads_on_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMAS["changelog"])
    assert resolve.live_view(none).count() == resolve.point_get(none, b"").count() == resolve.generations(none, 5).count() == 0
    assert resolve.multi_get(none, spark.createDataFrame([(1, bytearray(b""))], "db_id bigint, key_entry binary")).collect()[0]["found"] is False
