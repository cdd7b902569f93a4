"""The registered queries of the core: each takes (spark, directory) and runs over whole tables.

Keys and values come out as upper-case hexadecimal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.expressions import key_hex, valid_record
from siltstone.operators import catalog, changes, checks, compaction, incremental, references, resolve, runs, wal
from siltstone.operators.small_files import SmallFiles
from siltstone.sources.tables import load, scratch
from siltstone.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]

#: The key of point queries: it occurs in many stores and is by far the hottest.
HOT_KEY = b"lease/coordinator"
#: The interval of range queries.
LOW, HIGH = b"acct/", b"acct0"
#: Thresholds that make some stores of the test data due for compaction.
OPTIONS = compaction.CompactionOptions(
    level_limits=(150_000, 400_000, 4_000_000, 40_000_000, 400_000_000), target_sizes=(16_384,) * 7
)
GENERATION = 1_000
OUTPUT_BYTES = 2_048
#: Records whose sequence is a multiple of this get a wrong checksum in the recovery query.
DAMAGED = 97



def _tie():
    return [-F.col("log_no")]



def _out(df: DataFrame, *cols: str) -> DataFrame:
    """The columns, with binary key_entry, value_entry and the like as hexadecimal."""
    names = {"key_entry": "key_hex", "value_entry": "value_hex"}
    kinds = dict(df.dtypes)
    return df.select(
        *[key_hex(c).alias(names.get(c, c)) if kinds[c] == "binary" else F.col(c) for c in cols]
    )


def live_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records of live tables, each once."""
    return files(spark, d).records()


def files(spark: SparkSession, d: str) -> SmallFiles:
    return SmallFiles(*(load(spark, d, t) for t in ("table_meta", "sst_footers", "run_records", "level_targets")))


def log(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "changelog")


def unflushed(spark: SparkSession, d: str) -> DataFrame:
    """Log records of files not yet read into tables: what a memtable would hold."""
    tables = (load(spark, d, t) for t in ("changelog", "manifest_edits", "wal_headers"))
    return incremental.split_log(*tables).where("NOT was_read")


# Reads


def latest_view(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.latest_view(log(spark, d), _tie()), "db_id", "key_entry", "value_entry", "type", "seq_num")


def live_view(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.live_view(log(spark, d), _tie()), "db_id", "key_entry", "value_entry", "seq_num")


def live_count(spark: SparkSession, d: str) -> DataFrame:
    won = resolve.latest_view(log(spark, d), _tie(), carry=("type",))
    return won.where("type = 0").groupBy("db_id").agg(F.count(F.lit(1)).alias("n_live"))


def point_get(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.point_get(log(spark, d), HOT_KEY, _tie()), "db_id", "value_entry", "seq_num")


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = load(spark, d, "incoming_records")
    return _out(resolve.multi_get(log(spark, d), wanted, _tie()), "db_id", "key_entry", "found", "value_entry", "seq_num")


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.range_scan(log(spark, d), LOW, HIGH, _tie()), "db_id", "key_entry", "value_entry", "seq_num")


def read_path(spark: SparkSession, d: str) -> DataFrame:
    """The whole read path for arriving keys: newest of the unflushed log and the live tables; tombstones hide values."""
    cols = ["db_id", "key_entry", "value_entry", "type", "seq_num"]
    memory = unflushed(spark, d).select(*cols, (-F.col("log_no")).alias("rank"))
    both = memory.unionByName(live_runs(spark, d).select(*cols, F.lit(-(2**62)).alias("rank")))
    found = resolve.multi_get(both, load(spark, d, "incoming_records"), [F.col("rank")])
    return _out(found, "db_id", "key_entry", "found", "seq_num")


def known_keys(spark: SparkSession, d: str) -> DataFrame:
    """How many arriving keys are live in their store, and how many are not: semi and anti join in one."""
    keys = load(spark, d, "incoming_records").select("db_id", "key_entry").where("key_entry IS NOT NULL").distinct()
    live = resolve.live_view(log(spark, d), _tie()).select("db_id", "key_entry")
    found = keys.join(live.withColumn("known", F.lit(True)), ["db_id", "key_entry"], "left")
    return found.groupBy("db_id", F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


def memtable_get(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.latest_view(unflushed(spark, d), _tie()), "db_id", "key_entry", "value_entry", "type", "seq_num")


def dedup_identity(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.dedup_identity(log(spark, d), "log_no"), "db_id", "key_entry", "seq_num", "log_no", "type", "n_rejected")


def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return _out(resolve.merge_runs(live_runs(spark, d)), "db_id", "key_entry", "seq_num", "level", "table_id", "type")


def order_positions(spark: SparkSession, d: str) -> DataFrame:
    """The places of records in the three ordered outputs: merge of runs, dump of the log, range scan."""
    outputs = {
        "merge": resolve.merge_order(live_runs(spark, d)),
        "dump": (log(spark, d).where(valid_record()).drop("logged_at"), ["db_id", "key_entry", F.col("seq_num").desc(), "log_no"]),
        "scan": (resolve.range_scan(log(spark, d), LOW, HIGH, _tie()), resolve.KEY),
    }
    out = None
    for kind, (rows, order) in outputs.items():
        one = _out(resolve.numbered(rows.distinct(), order), "db_id", "key_entry", "seq_num", "position").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def ordered_dump(spark: SparkSession, d: str) -> DataFrame:
    ordered = log(spark, d).where(valid_record()).orderBy("db_id", "key_entry", F.col("seq_num").desc(), "log_no")
    return _out(ordered, "db_id", "key_entry", "seq_num", "log_no", "type")


def generations(spark: SparkSession, d: str) -> DataFrame:
    return resolve.generations(log(spark, d), GENERATION)


def oldest_generation(spark: SparkSession, d: str) -> DataFrame:
    per = resolve.generations(unflushed(spark, d), GENERATION)
    first = per.groupBy("db_id").agg(F.min(F.struct("generation_id", "n_records")).alias("g"))
    return first.select("db_id", "g.generation_id", "g.n_records")


def memtable_usage(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("key_entry") + F.coalesce(F.octet_length("value_entry"), F.lit(0))
    return unflushed(spark, d).groupBy("db_id").agg(F.sum(size).alias("n_bytes"), F.count(F.lit(1)).alias("n_records"))


# Runs


def sstable_get(spark: SparkSession, d: str) -> DataFrame:
    return _out(runs.table_get(live_runs(spark, d), HOT_KEY), "db_id", "table_id", "seq_num", "type", "value_entry")


def pruned_get(spark: SparkSession, d: str) -> DataFrame:
    """The whole pruned read of one key in every store: level order and key range, Bloom section, block index, record."""
    candidates = catalog.candidate_tables(load(spark, d, "table_meta"), HOT_KEY)
    got = runs.pruned_get(live_runs(spark, d), candidates, load(spark, d, "bloom_sections"), HOT_KEY)
    return _out(got, "db_id", "n_in_range", "n_probed", "seq_num", "type", "value_entry")


def table_meta(spark: SparkSession, d: str) -> DataFrame:
    t = runs.table_stats(live_runs(spark, d))
    return _out(t, *t.columns)


def block_index(spark: SparkSession, d: str) -> DataFrame:
    return _out(runs.block_index(live_runs(spark, d)), "db_id", "table_id", "block_no", "first_key", "last_key", "n_records")


def index_candidates(spark: SparkSession, d: str) -> DataFrame:
    return runs.index_candidates(runs.block_index(live_runs(spark, d)), HOT_KEY)


def bloom_build(spark: SparkSession, d: str) -> DataFrame:
    built = runs.bloom_build(live_runs(spark, d))
    return built.select("db_id", "table_id", "key_count", F.array_join(F.col("slots").cast("array<string>"), " ").alias("slots"))


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    return runs.bloom_probe(load(spark, d, "bloom_sections"), HOT_KEY)


def estimate_size(spark: SparkSession, d: str) -> DataFrame:
    return runs.estimate_size(live_runs(spark, d))


def block_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = runs.pack_blocks(live_runs(spark, d))
    return packed.groupBy("db_id", "table_id", "packed_block").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("record_size").alias("n_bytes")
    )


def output_split(spark: SparkSession, d: str) -> DataFrame:
    split = runs.split_outputs(live_runs(spark, d), OUTPUT_BYTES)
    return split.groupBy("db_id", "table_id", "file_no").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("record_size").alias("n_bytes")
    )


def record_checksums(spark: SparkSession, d: str) -> DataFrame:
    return runs.record_checksums(live_runs(spark, d))


# Catalog


def manifest_replay(spark: SparkSession, d: str) -> DataFrame:
    return catalog.replay(load(spark, d, "manifest_edits"))


def counter_state(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counters(load(spark, d, "manifest_edits"))


def edit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.edit_outcomes(load(spark, d, "manifest_edits"))


def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    return catalog.violations(load(spark, d, "table_meta"), load(spark, d, "manifest_edits"))


def counter_violations(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counter_violations(load(spark, d, "manifest_edits"))


def edit_recovery(spark: SparkSession, d: str) -> DataFrame:
    return catalog.recovery(load(spark, d, "manifest_edits"))


def _refused(spark: SparkSession, d: str, op: str) -> DataFrame:
    """Rows of edits that did not take effect."""
    lost = (F.col("op") == op) & F.col("commit_state").isin("failed", "torn")
    return load(spark, d, "manifest_edits").where(lost)


def add_violations(spark: SparkSession, d: str) -> DataFrame:
    """Which adds of edits that did not take effect could not be made now."""
    return checks.add_violations(_refused(spark, d, "add"), load(spark, d, "table_meta"))


def remove_violations(spark: SparkSession, d: str) -> DataFrame:
    """Which deletes of edits that did not take effect would have no effect now."""
    return checks.remove_violations(_refused(spark, d, "delete"), load(spark, d, "table_meta"))


def level_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.level_stats(load(spark, d, "table_meta"))


def candidate_tables(spark: SparkSession, d: str) -> DataFrame:
    return catalog.candidate_tables(load(spark, d, "table_meta"), HOT_KEY)


def overlapping_tables(spark: SparkSession, d: str) -> DataFrame:
    return catalog.overlapping_tables(load(spark, d, "table_meta"), LOW, HIGH).select("db_id", "table_id", "level")


# Compaction


def should_compact(spark: SparkSession, d: str) -> DataFrame:
    return compaction.should_compact(load(spark, d, "table_meta"), OPTIONS)


def pick_source(spark: SparkSession, d: str) -> DataFrame:
    return compaction.pick_source(load(spark, d, "table_meta"))


def compaction_plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction.plan(load(spark, d, "table_meta"), OPTIONS)


def key_spans(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "table_meta")
    return _out(compaction.key_spans(compaction.plan(t, OPTIONS), t), "db_id", "smallest_key", "largest_key", "n_tables")


def plan_violations(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "table_meta")
    return compaction.plan_violations(compaction.plan(t, OPTIONS), t, OPTIONS)


def stale_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Planned inputs that the replayed edit log does not have at their level."""
    inputs = compaction.plan(load(spark, d, "table_meta"), OPTIONS)
    return compaction.stale_inputs(inputs, catalog.replay(load(spark, d, "manifest_edits")))


def stale_after_commit(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a plan that are gone once the plan has been committed: it can't be run twice."""
    inputs = compaction.plan(load(spark, d, "table_meta"), OPTIONS)
    live = catalog.replay(load(spark, d, "manifest_edits")).join(inputs, ["db_id", "table_id", "level"], "left_anti")
    return compaction.stale_inputs(inputs, live)


def damaged_plan(spark: SparkSession, d: str) -> DataFrame:
    """What the validation says of a plan with planted faults: sources lost, levels wrong, tables repeated and renumbered."""
    t = load(spark, d, "table_meta")
    good = compaction.plan(t, OPTIONS)
    kept = good.where(~((F.col("role") == "source") & (F.col("db_id") % 4 == 0)))
    off = kept.withColumn("level", F.col("level") + (F.col("table_id") % 5 == 0).cast("int"))
    zero = off.withColumn("table_id", F.when(F.col("table_id") % 7 == 0, 0).otherwise(F.col("table_id")))
    deep = zero.withColumn("source_level", F.col("source_level") + F.when(F.col("db_id") % 3 == 0, 6).otherwise(0))
    return compaction.plan_violations(deep.unionByName(deep.where(F.col("table_id") % 3 == 0)), t, OPTIONS)


def compact_commit(spark: SparkSession, d: str) -> DataFrame:
    """Run the planned compactions and list the edits that commit them: inputs deleted, outputs added."""
    tables = (load(spark, d, t) for t in ("table_meta", "manifest_edits"))
    done = compaction.run(live_runs(spark, d), *tables, OPTIONS, scratch(spark, "compacted"))
    cols = ["db_id", "edit_no", "op", "table_id", "level", "record_count", "tombstone_count", "min_seq", "max_seq", "smallest_key",
            "largest_key", "data_bytes", "next_table_id"]
    return _out(done.edit, *cols)


def compact(spark: SparkSession, d: str) -> DataFrame:
    out = compaction.compact(live_runs(spark, d), load(spark, d, "table_meta"), OPTIONS)
    return _out(out, "db_id", "target_level", "key_entry", "seq_num", "type", "value_entry")


def compact_bottom(spark: SparkSession, d: str) -> DataFrame:
    return _out(compaction.merge(live_runs(spark, d), bottommost=True), "db_id", "key_entry", "seq_num", "value_entry")


def compact_range(spark: SparkSession, d: str) -> DataFrame:
    out = compaction.compact_range(live_runs(spark, d), LOW, HIGH)
    return _out(out, "db_id", "key_entry", "seq_num", "type", "value_entry")


# Checks


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    return checks.record_violations(log(spark, d))


def order_violations(spark: SparkSession, d: str) -> DataFrame:
    return checks.order_violations(live_runs(spark, d))


def index_check(spark: SparkSession, d: str) -> DataFrame:
    """A block index with planted faults against the records: entries left out, entries cut short."""
    real = runs.block_index(live_runs(spark, d)).drop("n_records")
    stored = real.where("block_no % 5 <> 4").withColumn("last_key", F.expr("if(block_no % 5 = 3, first_key, last_key)"))
    return checks.index_violations(live_runs(spark, d), stored)


def meta_consistency(spark: SparkSession, d: str) -> DataFrame:
    return checks.meta_consistency(load(spark, d, "table_meta"), live_runs(spark, d))


def bloom_consistency(spark: SparkSession, d: str) -> DataFrame:
    return checks.bloom_consistency(load(spark, d, "bloom_sections"), live_runs(spark, d))


# Write-ahead log


def _logged(spark: SparkSession, d: str) -> DataFrame:
    valid = log(spark, d).where(valid_record())
    return valid.drop("logged_at").distinct()


def wal_fragment(spark: SparkSession, d: str) -> DataFrame:
    return wal.fragment_stats(wal.to_fragments(_logged(spark, d), ["log_no"]))


def wal_reassemble(spark: SparkSession, d: str) -> DataFrame:
    back = wal.to_records(wal.to_fragments(_logged(spark, d), ["log_no"]))
    return back.groupBy("db_id", "wal_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.when(F.col("corruption").isNull(), 0).otherwise(1)).alias("n_corrupt"),
        F.sum(F.octet_length("key_entry")).alias("key_bytes"),
        F.sum(F.octet_length("value_entry")).alias("value_bytes"),
        F.min(F.hex("key_entry")).alias("least_key"),
    )


def wal_recover(spark: SparkSession, d: str) -> DataFrame:
    """Recovery of damaged logs: the checksums of some records are wrong, and files may lack a readable header.

    Per log file the records before the first damage, and what stopped reading (null: nothing).
    """
    fragments = wal.to_fragments(_logged(spark, d), ["log_no"])
    broken = F.col("seq_num") % DAMAGED == 0
    damaged = fragments.withColumn("checksum", F.col("checksum") + broken.cast("int"))
    back = wal.to_records(damaged, load(spark, d, "wal_headers"))
    whole = F.col("corruption").isNull()
    return back.groupBy("db_id", "wal_id").agg(
        F.sum(whole.cast("int")).alias("n_records"),
        F.max("corruption").alias("stopped_by"),
        F.sum(F.when(whole, F.octet_length("key_entry") + F.octet_length("value_entry")).otherwise(0)).alias("n_bytes"),
    )


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest view as a stream makes it: the log's files in micro-batches, merged into a published state."""
    state = upsert.LatestState(spark, scratch(spark, "stream-state"))
    # A pattern, since the log may be a file or a folder of files.
    stream = upsert.read_log(spark, f"{d}/changelog.parque[t]", files_per_batch=16)
    state.start(stream, scratch(spark, "stream-checkpoint")).awaitTermination()
    return _out(state.read(), "db_id", "key_entry", "value_entry", "type", "seq_num")


# Problems 1 to 4


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Current records of type put: db_id, key_hex, seq_num, log_no."""
    state = changes.apply_changes(
        log(spark, d).where(valid_record()), ["db_id", "key_entry"], "seq_num", "type",
        ["seq_num", "log_no"], replace=[0], delete=[1], tie="log_no",
    )
    return _out(state, "db_id", "key_entry", "seq_num", "log_no")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole current state with values; a put of an empty or null value is a live row."""
    state = changes.apply_changes(
        log(spark, d).where(valid_record()), ["db_id", "key_entry"], "seq_num", "type",
        ["seq_num", "value_entry", "logged_at"], replace=[0], delete=[1], tie="log_no",
    )
    return _out(state, "db_id", "key_entry", "seq_num", "value_entry", "logged_at")


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """The counters of every store from changes that set some of them and leave others as they were."""
    edits = load(spark, d, "manifest_edits").where("commit_state = 'synced'")
    fields = ["next_table_id", "next_sequence_number", "current_wal_id"]
    return changes.apply_changes(edits, ["db_id"], "edit_no", "op", fields, update=["counter"])


def _incremental_runs(spark: SparkSession, d: str) -> list[tuple[int, DataFrame]]:
    """Version and added rows of two runs into a published target: over the read files, then over the whole log."""
    tables = (load(spark, d, t) for t in ("changelog", "manifest_edits", "wal_headers"))
    marked = incremental.split_log(*tables)
    identity = ["db_id", "key_entry", "seq_num"]
    target = incremental.IncrementalTarget(spark, scratch(spark, "incremental"), identity)
    return [target.run(marked.where("was_read")), target.run(marked)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of key and sequence in unread log files and in no read one: db_id, key_hex, seq_num.

    The rows that the second run adds to the published target.
    """
    _, (_, fresh) = _incremental_runs(spark, d)
    return _out(fresh, "db_id", "key_entry", "seq_num")


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into a published target: one over the read files, one over the whole log; rows by version.

    The second run adds exactly the rows of p2_found.
    """
    done = _incremental_runs(spark, d)
    counts = [rows.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v)) for v, rows in done]
    return counts[0].unionByName(counts[1]).select("db_id", "version", "n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Live tables that are present and far too small: db_id, table_id."""
    return files(spark, d).small_tables().select("db_id", "table_id").distinct()


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Consolidate the small live tables; files before and after and the digest comparison per store and level."""
    return files(spark, d).run(scratch(spark, "small-files"))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can tell of the consolidation: rows, small and kept tables of every store and level, all rows whole."""
    return p3_files(spark, d).select("db_id", "level", "n_rows", "files_before", "files_kept", "record_bytes", "whole")


def _orphan_tables(spark: SparkSession, d: str):
    return (load(spark, d, t) for t in ("manifest_edits", "table_meta", "sst_footers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references: ref_kind, db_id, edit_no, table_id."""
    return references.orphan_rows(*_orphan_tables(spark, d)).select("ref_kind", "db_id", "edit_no", "table_id").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring table and month."""
    return references.orphan_counts(*_orphan_tables(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_state, p1_fields, p2_found, p2_runs, p3_found, p3_files, p3_rows, p4_found, p4_counts,
        live_view, latest_view, live_count, point_get, multi_get, range_scan, read_path, known_keys, memtable_get, dedup_identity, merge_runs,
        ordered_dump, order_positions, generations, oldest_generation, memtable_usage, sstable_get, pruned_get, table_meta, block_index,
        index_candidates, bloom_build, bloom_probe, estimate_size, block_packing, output_split, record_checksums,
        manifest_replay, counter_state, edit_outcomes, manifest_violations, counter_violations, edit_recovery, add_violations, remove_violations, level_stats, candidate_tables, overlapping_tables,
        should_compact, pick_source, compaction_plan, key_spans, plan_violations, stale_inputs, stale_after_commit, damaged_plan, compact, compact_commit, compact_bottom, compact_range, record_violations,
        order_violations, index_check, meta_consistency, bloom_consistency, wal_fragment, wal_reassemble, wal_recover, stream_latest,
    )
}
