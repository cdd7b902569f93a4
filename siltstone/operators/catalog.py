"""The catalog of tables: replay of the edit log, levels, candidates and invariants.

Catalog rows describe table files, so these tables are smaller than the data
by the size of a file; all functions still stay distributed and treat all
stores of a fleet at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

META = ["min_seq", "max_seq", "file_size", "record_count", "tombstone_count", "data_block_count", "data_bytes",
        "smallest_key", "largest_key"]


def synced(edits: DataFrame) -> DataFrame:
    """Edits that took effect."""
    return edits.where(F.col("commit_state") == "synced")


def replay(edits: DataFrame) -> DataFrame:
    """Live tables after all synced edits: db_id, table_id, level, edit_no of the add.

    Inside an edit deletes come before adds. One aggregation with a map-side
    partial; arrival order, repeats and ineffective deletes don't matter.
    """
    moves = synced(edits).where(F.col("op").isin("add", "delete"))
    at = F.struct("edit_no", F.when(F.col("op") == "add", 1).otherwise(0).alias("added"))
    last = moves.groupBy("db_id", "table_id", "level").agg(F.max(at).alias("last"))
    return last.where("last.added = 1").select("db_id", "table_id", "level", F.col("last.edit_no").alias("edit_no"))


def edit_outcomes(edits: DataFrame) -> DataFrame:
    """Per store and state (synced, failed, torn): edits and rows; only synced ones survive recovery."""
    return edits.groupBy("db_id", "commit_state").agg(
        F.countDistinct("edit_no").alias("n_edits"), F.count(F.lit(1)).alias("n_rows")
    )


def counters(edits: DataFrame) -> DataFrame:
    """Counters per store: the greatest ever set (they never go back), next_table_id at least one above any id added."""
    rows = synced(edits)
    added = F.when(F.col("op") == "add", F.col("table_id") + 1)
    return rows.groupBy("db_id").agg(
        F.greatest(F.max("next_table_id"), F.max(added)).alias("next_table_id"),
        F.max("next_sequence_number").alias("next_sequence_number"),
        F.max("current_wal_id").alias("current_wal_id"),
        F.max("edit_no").alias("last_edit_no"),
    )


def tables(catalog: DataFrame) -> DataFrame:
    """The catalog with one row per table; among repeated listings the greatest of each column."""
    return catalog.groupBy("db_id", "table_id", "level").agg(*[F.max(c).alias(c) for c in META])


def level_stats(catalog: DataFrame) -> DataFrame:
    """Tables and bytes per store and level; unknown sizes count as 0."""
    return tables(catalog).groupBy("db_id", "level").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum(F.coalesce("file_size", F.lit(0))).alias("n_bytes")
    )


def candidate_tables(catalog: DataFrame, key: bytes) -> DataFrame:
    """Tables whose key range holds a key, with ``lookup_rank``: level by level, in level 0 newest first."""
    k = F.lit(bytearray(key))
    hit = tables(catalog).where((F.col("smallest_key") <= k) & (F.col("largest_key") >= k))
    order = Window.partitionBy("db_id").orderBy("level", F.col("table_id").desc())
    return hit.select("db_id", "table_id", "level", F.row_number().over(order).alias("lookup_rank"))


def overlapping_tables(catalog: DataFrame, low: bytes, high: bytes) -> DataFrame:
    """Tables that overlap a key range, both ends included."""
    return tables(catalog).where(
        (F.col("smallest_key") <= F.lit(bytearray(high))) & (F.col("largest_key") >= F.lit(bytearray(low)))
    )


def violations(catalog: DataFrame, edits: DataFrame, max_levels: int = 7) -> DataFrame:
    """Broken catalog invariants: db_id, table_id, rule.

    Rules: reserved_id (0 or less), no_such_level, repeated_id (a table live
    at several levels), bad_range (smallest above largest, or min_seq above max_seq),
    bad_counts (more tombstones than records), bad_size (more data than file;
    unknown sizes pass), id_not_reserved (id at or above next_table_id),
    level_overlap (below level 0 a table begins at or before the end of any table that begins before it).
    """
    t = tables(catalog)
    rule = lambda cond, name: t.where(cond).select("db_id", "table_id", F.lit(name).alias("rule"))
    out = rule(F.col("table_id") <= 0, "reserved_id")
    out = out.unionByName(rule(F.col("level").isNull() | (F.col("level") < 0) | (F.col("level") >= max_levels), "no_such_level"))
    out = out.unionByName(
        rule((F.col("record_count") > 0) & ((F.col("smallest_key") > F.col("largest_key")) | (F.col("min_seq") > F.col("max_seq"))), "bad_range")
    )
    out = out.unionByName(rule(F.col("tombstone_count") > F.col("record_count"), "bad_counts"))
    out = out.unionByName(rule(F.col("data_bytes") > F.col("file_size"), "bad_size"))
    twice = t.groupBy("db_id", "table_id").count().where("count > 1")
    late = t.join(counters(edits).select("db_id", "next_table_id"), "db_id").where(F.col("table_id") >= F.col("next_table_id"))
    # The end of all tables before, not only of the last one: a wide table may reach past its successors.
    before = Window.partitionBy("db_id", "level").orderBy("smallest_key", "table_id").rowsBetween(Window.unboundedPreceding, -1)
    overlap = (
        t.where((F.col("level") > 0) & F.col("smallest_key").isNotNull())
        .withColumn("_before", F.max("largest_key").over(before))
        .where(F.col("smallest_key") <= F.col("_before"))
    )
    for rows, name in ((twice, "repeated_id"), (late, "id_not_reserved"), (overlap, "level_overlap")):
        out = out.unionByName(rows.select("db_id", "table_id", F.lit(name).alias("rule")))
    return out


def counter_violations(edits: DataFrame) -> DataFrame:
    """Counters of synced edits that break a rule: db_id, edit_no, counter, value, rule.

    zero (0 or less); regressed (below what an earlier edit of the store set);
    not_above_tables (a next_table_id not above the ids added up to and with its edit).
    A counter that breaks several is given with each. Null counters set nothing. Windows run over the edits of a store.
    """
    rows = synced(edits)
    names = ["next_table_id", "next_sequence_number", "current_wal_id"]
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in names]))
    each = (
        rows.where(F.col("op") == "counter").select("db_id", "edit_no", sets.alias("c")).select("db_id", "edit_no", "c.*")
        .where(F.col("value").isNotNull()).distinct()
    )
    added = rows.where(F.col("op") == "add").groupBy("db_id", "edit_no").agg(F.max("table_id").alias("value"))
    marks = each.unionByName(added.withColumn("counter", F.lit("added")))
    earlier = Window.partitionBy("db_id", "counter").orderBy("edit_no").rangeBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("db_id").orderBy("edit_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.withColumns(
        {"_before": F.max("value").over(earlier), "_added": F.max(F.when(F.col("counter") == "added", F.col("value"))).over(so_far)}
    ).where("counter <> 'added'")
    rules = F.array_compact(
        F.array(
            F.when(F.col("value") <= 0, "zero"),
            F.when(F.col("value") < F.col("_before"), "regressed"),
            F.when((F.col("counter") == "next_table_id") & (F.col("value") <= F.col("_added")), "not_above_tables"),
        )
    )
    return seen.select("db_id", "edit_no", "counter", "value", F.explode(rules).alias("rule"))


def recovery(edits: DataFrame) -> DataFrame:
    """What recovery of each store's edit log meets: db_id, last_edit_no, n_lost, n_failed, n_inside.

    last_edit_no is the newest synced edit. n_lost are torn edits after it: a
    tail that never was acknowledged and is ignored. n_inside are torn edits
    before it: the log went on after them, so each is damage that a reader of
    the raw log must refuse. Failed edits were refused when written.
    """
    numbered = edits.groupBy("db_id", "edit_no").agg(
        F.max((F.col("commit_state") == "synced").cast("int")).alias("_s"), F.max((F.col("commit_state") == "torn").cast("int")).alias("_t"),
        F.max((F.col("commit_state") == "failed").cast("int")).alias("_f"),
    )
    last = numbered.groupBy("db_id").agg(F.max(F.when(F.col("_s") == 1, F.col("edit_no"))).alias("last_edit_no"))
    after = F.col("edit_no") > F.coalesce("last_edit_no", F.lit(0))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return numbered.join(last, "db_id").groupBy("db_id", "last_edit_no").agg(
        count((F.col("_t") == 1) & after).alias("n_lost"), count(F.col("_f") == 1).alias("n_failed"),
        count((F.col("_t") == 1) & ~after).alias("n_inside"),
    )
