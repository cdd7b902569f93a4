"""Compaction: options, the choice of inputs for all stores at once, and the merge itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import record_bytes
from siltstone.functions.joins import join_small
from siltstone.operators.catalog import counters, level_stats, replay, tables
from siltstone.operators.resolve import latest_view
from siltstone.operators.runs import fold_sorted
from siltstone.sources.published import Folder
from siltstone.sources.tables import scratch, written

MIB = 1 << 20


@dataclass(frozen=True)
class CompactionOptions:
    """When to compact and how large outputs are; sizes in bytes, one entry per level."""

    max_levels: int = 7
    l0_trigger: int = 4
    # Limits of levels 1 to 5 and target sizes of levels 0 to 6.
    level_limits: tuple[int, ...] = (64 * MIB, 640 * MIB, 6400 * MIB, 64000 * MIB, 640000 * MIB)
    target_sizes: tuple[int, ...] = field(default=tuple(n * MIB for n in (8, 8, 16, 32, 64, 128, 256)))

    def __post_init__(self) -> None:
        if self.max_levels < 2:
            raise ValueError("at least two levels are needed")
        if self.l0_trigger < 1:
            raise ValueError("the level 0 trigger must be positive")
        if len(self.level_limits) < self.max_levels - 2 or any(x <= 0 for x in self.level_limits):
            raise ValueError("every level between the first and the last needs a positive limit")
        if len(self.target_sizes) < self.max_levels or any(x <= 0 for x in self.target_sizes):
            raise ValueError("every level needs a positive target size")

    def limit_of(self) -> Column:
        """Limit of column ``level``; null for level 0 and the last one."""
        pairs = [x for i in range(1, self.max_levels - 1) for x in (F.lit(i), F.lit(self.level_limits[i - 1]))]
        return F.create_map(*pairs)[F.col("level")] if pairs else F.lit(None).cast("bigint")


def source_levels(catalog: DataFrame, options: CompactionOptions) -> DataFrame:
    """(db_id, source_level) of stores that need compaction.

    Level 0 once it has ``l0_trigger`` tables, else the lowest level whose
    bytes exceed its limit; the last level never is a source.
    """
    stats = level_stats(catalog).withColumn("_limit", options.limit_of())
    due = ((F.col("level") == 0) & (F.col("n_tables") >= options.l0_trigger)) | (F.col("n_bytes") > F.col("_limit"))
    return stats.where(due).groupBy("db_id").agg(F.min("level").alias("source_level"))


def should_compact(catalog: DataFrame, options: CompactionOptions) -> DataFrame:
    """Every store with whether it needs compaction."""
    due = source_levels(catalog, options).withColumn("due", F.lit(True))
    stores = catalog.select("db_id").distinct()
    return stores.join(due, "db_id", "left").select("db_id", F.coalesce("due", F.lit(False)).alias("should_compact"))


def pick_source(catalog: DataFrame) -> DataFrame:
    """The largest table of every store and level below 0; ties go to the smallest id, unknown sizes count as 0."""
    best = F.max(F.struct(F.coalesce("file_size", F.lit(0)).alias("size"), (-F.col("table_id")).alias("order")))
    return (
        tables(catalog).where("level > 0").groupBy("db_id", "level").agg(best.alias("b"))
        .select("db_id", "level", (-F.col("b.order")).alias("table_id"), F.col("b.size").alias("file_size"))
    )


def plan(catalog: DataFrame, options: CompactionOptions) -> DataFrame:
    """Input tables of one compaction per store that needs it.

    db_id, source_level, table_id, level, role (source, overlap). Sources are
    all of level 0 or the largest table of a deeper level; overlaps are the
    tables of the next level whose range meets the sources' joint range.
    """
    t = tables(catalog)
    due = source_levels(catalog, options)
    chosen = pick_source(catalog).select("db_id", "level", F.col("table_id").alias("_chosen"))
    sources = (
        t.join(due, "db_id")
        .where(F.col("level") == F.col("source_level"))
        .join(chosen, ["db_id", "level"], "left")
        .where((F.col("level") == 0) | (F.col("table_id") == F.col("_chosen")))
    )
    span = sources.groupBy("db_id", "source_level").agg(
        F.min("smallest_key").alias("_low"), F.max("largest_key").alias("_high")
    )
    overlaps = t.join(span, "db_id").where(
        (F.col("level") == F.col("source_level") + 1)
        & (F.col("smallest_key") <= F.col("_high"))
        & (F.col("largest_key") >= F.col("_low"))
    )
    cols = ["db_id", "source_level", "table_id", "level"]
    return sources.select(*cols, F.lit("source").alias("role")).unionByName(
        overlaps.select(*cols, F.lit("overlap").alias("role"))
    )


def merge(runs: DataFrame, bottommost: bool = False) -> DataFrame:
    """Newest version of every key of the input runs; at the bottommost level tombstones go.

    Equal sequences of a key in two runs: the lower level wins, then the higher table id.
    """
    won = latest_view(runs, tie=[-F.col("level"), F.col("table_id")])
    return won.where(F.col("type") == 0) if bottommost else won


def _merged(runs: DataFrame, catalog: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs of a plan (a written table): db_id, key, seq_num, value, type, target_level."""
    deepest = tables(catalog).groupBy("db_id").agg(F.max("level").alias("_deepest"))
    targets = (
        inputs.groupBy("db_id").agg((F.max("source_level") + 1).alias("target_level"))
        .join(deepest, "db_id").withColumn("_bottom", F.col("_deepest") <= F.col("target_level"))
    )
    own = inputs.select("db_id", "table_id").distinct()
    merged = merge(join_small(runs, own, ["db_id", "table_id"], "left_semi"))
    return (
        join_small(merged, targets.select("db_id", "target_level", "_bottom"), ["db_id"], "inner")
        .where(~((F.col("type") == 1) & F.col("_bottom")))
        .drop("_bottom")
    )


def compact(runs: DataFrame, catalog: DataFrame, options: CompactionOptions) -> DataFrame:
    """Run the planned compaction of every store: db_id, key, seq_num, value, type, target_level of all outputs.

    Tombstones go where no table of the store lies deeper than the target.
    Records of tables that are not inputs are not read past the join with the
    plan, which is written once.
    """
    return _merged(runs, catalog, written(plan(catalog, options), "compaction-plan"))


@dataclass(frozen=True)
class Compacted:
    """A compaction that was run: the edit to commit, and where its output files are (by db_id and table_id)."""

    edit: DataFrame
    files: str


def run(runs: DataFrame, catalog: DataFrame, edits: DataFrame, options: CompactionOptions, folder: str) -> Compacted:
    """Run the planned compactions of all stores as a job: write the outputs and make the edits that commit them.

    The plan must be valid and all its inputs live by the edit log, else
    RuntimeError is raised before anything is written. Outputs of a store
    are cut once a file holds the target size of its level, and get the ids
    after the store's last. The edit of a store deletes its inputs, adds its
    outputs (statistics are taken from the files read back) and moves
    next_table_id; until it is appended to the log, nothing has changed, and
    the folder may be removed. Inputs of a compaction are bounded (level 0, or
    one table and those it overlaps), so cutting one store's outputs in order is.
    """
    inputs = written(plan(catalog, options), "compaction-plan")
    broken = plan_violations(inputs, catalog, options).limit(3).collect()
    stale = stale_inputs(inputs, replay(edits)).limit(3).collect()
    if broken or stale:
        raise RuntimeError(f"the plan is invalid ({broken}) or stale ({stale})")
    steps = Folder(runs.sparkSession, scratch(runs.sparkSession, "compaction"))
    merged = written(_merged(runs, catalog, inputs), "", f"{steps.path}/merged")
    levels = F.create_map(*[x for i, n in enumerate(options.target_sizes) for x in (F.lit(i), F.lit(n))])
    sized = merged.select("db_id", "key_entry", record_bytes().alias("_size"), levels[F.col("target_level")].alias("_target"))
    both = sized.select("db_id", "key_entry", F.struct("_size", "_target").alias("_both"))

    def step(state, both, _):
        no, used = state or (0, 0)
        if used >= both["_target"]:
            no, used = no + 1, 0
        return (no, used + both["_size"]), no

    cut = fold_sorted(both, ["db_id"], ["key_entry"], "_both", step, "file_no").select("db_id", "key_entry", "file_no")
    ids = counters(edits).select("db_id", "next_table_id", "last_edit_no")
    rows = (
        join_small(merged.join(cut, ["db_id", "key_entry"]), ids, ["db_id"], "left")
        .withColumn("table_id", F.coalesce("next_table_id", F.lit(1)) + F.col("file_no"))
        .select("db_id", "table_id", F.col("target_level").alias("level"), "key_entry", "value_entry", "type", "seq_num")
    )
    # Files by store and table, a table by one task; the range keeps tables of a store side by side.
    (
        rows.repartitionByRange("db_id", "table_id").sortWithinPartitions("db_id", "table_id", "key_entry")
        .write.partitionBy("db_id", "table_id").parquet(folder)
    )
    back = merged.sparkSession.read.schema(rows.schema).parquet(folder)
    stats = back.groupBy("db_id", "table_id", "level").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum("type").alias("tombstone_count"),
        F.min("seq_num").alias("min_seq"), F.max("seq_num").alias("max_seq"),
        F.min("key_entry").alias("smallest_key"), F.max("key_entry").alias("largest_key"), F.sum(record_bytes()).alias("data_bytes"),
    )
    edit = version_edit(inputs, stats, ids)
    steps.delete("")
    return Compacted(edit, folder)


def version_edit(inputs: DataFrame, outputs: DataFrame, ids: DataFrame) -> DataFrame:
    """One edit for each store of a plan, in the form of the edit log: deletes of its inputs, adds of its outputs, the counter.

    ``ids`` has db_id, next_table_id and last_edit_no. A store whose outputs are all dropped only deletes.
    """
    deletes = inputs.select("db_id", F.lit("delete").alias("op"), "table_id", "level")
    adds = outputs.withColumn("op", F.lit("add"))
    top = outputs.groupBy("db_id").agg((F.max("table_id") + 1).alias("next_table_id")).withColumn("op", F.lit("counter"))
    rows = deletes.unionByName(adds, allowMissingColumns=True).unionByName(top, allowMissingColumns=True)
    number = F.coalesce("last_edit_no", F.lit(0)) + 1
    return (
        join_small(rows, ids.select("db_id", "last_edit_no"), ["db_id"], "left")
        .withColumns({"edit_no": number, "commit_state": F.lit("synced")})
        .drop("last_edit_no")
    )


def compact_range(runs: DataFrame, low: bytes, high: bytes, bottommost: bool = False) -> DataFrame:
    """Merge of all runs restricted to low <= key <= high; the interval reaches the scan."""
    inside = (F.col("key_entry") >= F.lit(bytearray(low))) & (F.col("key_entry") <= F.lit(bytearray(high)))
    return merge(runs.where(inside), bottommost)


def key_spans(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Key range over all inputs of a plan: db_id, smallest_key, largest_key, n_tables."""
    ranges = tables(catalog).select("db_id", "table_id", "level", "smallest_key", "largest_key")
    return inputs.join(ranges, ["db_id", "table_id", "level"]).groupBy("db_id").agg(
        F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"), F.count(F.lit(1)).alias("n_tables")
    )


def plan_violations(inputs: DataFrame, catalog: DataFrame, options: CompactionOptions) -> DataFrame:
    """What is wrong with a plan: db_id, rule; a valid plan gives no rows.

    no_source, repeated_table, reserved_id (0 or less), wrong_level (a source
    off the source level, an overlap off the next), last_level (nothing lies
    below the source), bad_range (an input whose keys are in no order).
    """
    by = inputs.groupBy("db_id")
    rows = inputs.join(tables(catalog).select("db_id", "table_id", "level", "smallest_key", "largest_key"), ["db_id", "table_id", "level"], "left")
    want = F.col("source_level") + F.when(F.col("role") == "source", 0).otherwise(1)
    broken = [
        by.agg(F.max((F.col("role") == "source").cast("int")).alias("s")).where("s = 0").select("db_id", F.lit("no_source").alias("rule")),
        inputs.groupBy("db_id", "table_id").count().where("count > 1").select("db_id", F.lit("repeated_table").alias("rule")),
        inputs.where("table_id <= 0").select("db_id", F.lit("reserved_id").alias("rule")),
        inputs.where(F.col("level") != want).select("db_id", F.lit("wrong_level").alias("rule")),
        inputs.where(F.col("source_level") + 1 >= options.max_levels).select("db_id", F.lit("last_level").alias("rule")),
        rows.where(F.col("smallest_key") > F.col("largest_key")).select("db_id", F.lit("bad_range").alias("rule")),
    ]
    out = broken[0]
    for b in broken[1:]:
        out = out.unionByName(b)
    return out.distinct()


def stale_inputs(inputs: DataFrame, live: DataFrame) -> DataFrame:
    """Planned inputs that are no longer live at their level; a plan may run only if there are none."""
    return inputs.join(live, ["db_id", "table_id", "level"], "left_anti")
