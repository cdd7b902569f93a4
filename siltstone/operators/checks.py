"""Validation queries: rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.expressions import BLOCK_BYTES, BLOCK_HEADER_BYTES, record_bytes
from siltstone.operators.runs import TABLE, bloom_build, bloom_valid, table_stats


def record_violations(records: DataFrame) -> DataFrame:
    """Records a log must not hold, counted by store and first broken rule; exact repeats count each time."""
    rule = (
        F.when(F.col("key_entry").isNull(), "no_key")
        .when(F.col("seq_num").isNull() | (F.col("seq_num") <= 0), "bad_sequence")
        .when(F.col("type").isNull() | ~F.col("type").isin(0, 1), "bad_type")
        .when(record_bytes() + BLOCK_HEADER_BYTES > BLOCK_BYTES, "too_large")
    )
    return records.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("db_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def order_violations(runs: DataFrame) -> DataFrame:
    """Blocks of a table that begin before the end of the block before them, or repeat a key and sequence.

    Blocks come in order of (key, newest first); neighbours may share a key.
    Windows run over the blocks of one table, which its file size bounds.
    """
    blocks = runs.groupBy(*TABLE, "block_no").agg(
        F.min(F.struct("key_entry", (-F.col("seq_num")).alias("s"))).alias("first"),
        F.max(F.struct("key_entry", (-F.col("seq_num")).alias("s"))).alias("last"),
        (F.count(F.lit(1)) - F.countDistinct("key_entry", "seq_num")).alias("n_repeated"),
    )
    order = Window.partitionBy(*TABLE).orderBy("block_no")
    return (
        blocks.withColumn("before", F.lag("last").over(order))
        .where((F.col("first") <= F.col("before")) | (F.col("n_repeated") > 0))
        .select(*TABLE, "block_no", F.coalesce(F.col("first") <= F.col("before"), F.lit(False)).alias("out_of_order"), "n_repeated")
    )


def meta_consistency(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """Tables whose catalog row disagrees with their records, with both record counts.

    Compared: record_count, tombstone_count, min_seq, max_seq, smallest and
    largest key. A table without records compares as count 0.
    """
    real = table_stats(runs).drop("level", "data_block_count", "record_bytes")
    names = ["record_count", "tombstone_count", "min_seq", "max_seq", "smallest_key", "largest_key"]
    real = real.select(*TABLE, *[F.col(c).alias(f"_{c}") for c in names])
    said = catalog.select(*TABLE, *names).distinct()
    both = said.join(real, TABLE, "left")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.where(~same).select(
        *TABLE, "record_count", F.coalesce("_record_count", F.lit(0).cast("bigint")).alias("real_record_count")
    )


def bloom_consistency(sections: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored Bloom sections that disagree with their table's records: db_id, table_id, problem.

    malformed; misses_a_key (a slot of a record isn't set, so a key would be
    denied); too_many_slots; wrong_count (records, not distinct keys). The
    first that holds is given; sections of tables without records are skipped.
    """
    stored = sections.distinct().select(
        *TABLE, bloom_valid().alias("_valid"), F.col("key_count").alias("_said"),
        F.expr("filter(sequence(0, 127), i -> substring(hex(mask), 2 * i + 2, 1) = '1')").alias("_set"),
    )
    problem = (
        F.when(~F.col("_valid"), "malformed")
        .when(F.size(F.array_except("slots", "_set")) > 0, "misses_a_key")
        .when(F.size(F.array_except("_set", "slots")) > 0, "too_many_slots")
        .when(F.col("_said") != F.col("key_count"), "wrong_count")
    )
    return stored.join(bloom_build(runs), TABLE).select(*TABLE, problem.alias("problem")).where("problem IS NOT NULL")


def add_violations(adds: DataFrame, live: DataFrame, max_levels: int = 7) -> DataFrame:
    """Tables that may not be added to a catalog: db_id, table_id, rule (the first that is broken).

    reserved_id (null, 0 or less), no_such_level, bad_range, known_id (live in
    the store at any level, or added more than once), overlap (below level 0,
    with a live or another added table of the level, ends included).

    Overlaps come from one sort of all ranges of a level: a range meets an
    earlier one if it begins at or before the greatest end so far, and a later
    one if it ends at or after the least beginning to come; nothing is paired.
    """
    cols = ["db_id", "table_id", "level", "smallest_key", "largest_key"]
    known = live.select("db_id", "table_id").distinct().withColumn("_known", F.lit(True))
    own = F.when(F.col("table_id").isNull() | (F.col("table_id") <= 0), "reserved_id").when(
        F.col("level").isNull() | (F.col("level") < 0) | (F.col("level") >= max_levels), "no_such_level"
    ).when(F.col("smallest_key") > F.col("largest_key"), "bad_range")
    times = F.count(F.lit(1)).over(Window.partitionBy("db_id", "table_id"))
    ruled = adds.select(*cols).distinct().withColumn("_times", times).join(known, ["db_id", "table_id"], "left").withColumn(
        "rule", F.coalesce(own, F.when(F.coalesce("_known", F.lit(False)) | (F.col("_times") > 1), "known_id"))
    )
    clear = ruled.where(F.col("rule").isNull()).select(*cols, F.lit(True).alias("_new"))
    both = clear.unionByName(live.select(*cols).distinct().withColumn("_new", F.lit(False))).where(
        (F.col("level") > 0) & F.col("smallest_key").isNotNull() & F.col("largest_key").isNotNull()
    )
    order = Window.partitionBy("db_id", "level").orderBy("smallest_key", "largest_key", "table_id", "_new")
    # Ranges that begin later, of an added table with an older one: the older begins at or before the added one's end.
    meets = both.withColumns(
        {
            "_end": F.max("largest_key").over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "_begin": F.min("smallest_key").over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where(F.col("_new") & ((F.col("smallest_key") <= F.col("_end")) | (F.col("largest_key") >= F.col("_begin"))))
    overlap = meets.select("db_id", "table_id", F.lit("overlap").alias("rule"))
    return ruled.where(F.col("rule").isNotNull()).select("db_id", "table_id", "rule").unionByName(overlap).distinct()


def remove_violations(removes: DataFrame, live: DataFrame) -> DataFrame:
    """Removals (db_id, table_id, level; a null level means any) that have no effect: with ``rule``.

    reserved_id (null, 0 or less), not_found (no such table in the store),
    wrong_level (live, but at another level), repeated (removed more than once).
    """
    at = live.select("db_id", "table_id", F.col("level").alias("_at")).distinct()
    # A table is live at one level at most; where a catalog breaks that, any of them counts.
    levels = at.groupBy("db_id", "table_id").agg(F.collect_set("_at").alias("_levels"))
    asked = removes.select("db_id", "table_id", "level").withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("db_id", "table_id")))
    rule = (
        F.when(F.col("table_id").isNull() | (F.col("table_id") <= 0), "reserved_id")
        .when(F.col("_levels").isNull(), "not_found")
        .when(F.col("level").isNotNull() & ~F.array_contains("_levels", F.col("level")), "wrong_level")
        .when(F.col("_times") > 1, "repeated")
    )
    return (
        asked.join(levels, ["db_id", "table_id"], "left")
        .select("db_id", "table_id", "level", rule.alias("rule"))
        .where(F.col("rule").isNotNull())
        .distinct()
    )


def index_violations(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks whose stored index entry (db_id, table_id, block_no, first_key, last_key) disagrees with the records.

    missing (records but no entry), empty (an entry without records), bad_range (first above last), wrong_keys.
    """
    real = runs.groupBy(*TABLE, "block_no").agg(F.min("key_entry").alias("_first"), F.max("key_entry").alias("_last"))
    both = stored.select(*TABLE, "block_no", "first_key", "last_key", F.lit(True).alias("_said")).join(
        real.withColumn("_real", F.lit(True)), [*TABLE, "block_no"], "full"
    )
    rule = (
        F.when(F.col("_said").isNull(), "missing")
        .when(F.col("_real").isNull(), "empty")
        .when(F.col("first_key") > F.col("last_key"), "bad_range")
        .when(~(F.col("first_key").eqNullSafe(F.col("_first")) & F.col("last_key").eqNullSafe(F.col("_last"))), "wrong_keys")
    )
    return both.select(*TABLE, "block_no", rule.alias("rule")).where(F.col("rule").isNotNull())
