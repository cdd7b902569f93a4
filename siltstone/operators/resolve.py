"""Version resolution: the newest version of every key, and reads on top of it.

All functions take records with db_id, key_entry, value_entry, type, seq_num.
A store and key is one logical key. Tombstones are dropped only after the
winner is known. Rows that are no valid records are ignored; empty keys and
empty or null values are ordinary; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.expressions import valid_record
from siltstone.functions.joins import join_small
from siltstone.sources.tables import written

KEY = ["db_id", "key_entry"]


def latest_view(records: DataFrame, tie: Sequence[Column] = (), carry: Sequence[str] = ("value_entry", "type")) -> DataFrame:
    """One row per store and key, the record with the greatest seq_num; tombstones included.

    ``tie`` are descending order terms for equal sequences. The winner is one
    ``max`` over a struct, whose map-side partial leaves one row per key and
    task however hot a key is; no window, so nothing gathers a key's history.
    """
    names = [f"_t{i}" for i in range(len(tie))]
    order = F.struct("seq_num", *[t.alias(n) for t, n in zip(tie, names, strict=True)], *carry)
    won = records.where(valid_record()).groupBy(*KEY).agg(F.max(order).alias("w"))
    return won.select(*KEY, F.col("w.seq_num").alias("seq_num"), *[F.col(f"w.{c}").alias(c) for c in carry])


def live_view(records: DataFrame, tie: Sequence[Column] = ()) -> DataFrame:
    """The latest view without deleted keys."""
    return latest_view(records, tie).where(F.col("type") == 0).drop("type")


def point_get(records: DataFrame, key: bytes, tie: Sequence[Column] = ()) -> DataFrame:
    """The live value of one key in every store; the key's equality reaches the Parquet scan."""
    return live_view(records.where(F.col("key_entry") == F.lit(bytearray(key))), tie)


def multi_get(records: DataFrame, wanted: DataFrame, tie: Sequence[Column] = ()) -> DataFrame:
    """A row for every wanted store and key, each once: found, and the live value if found.

    Both sides shuffle on the key once; the view is already partitioned on it.
    """
    live = live_view(records, tie).withColumn("found", F.lit(True))
    keys = wanted.select(*KEY).where(F.col("key_entry").isNotNull()).distinct()
    return keys.join(live, KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(records: DataFrame, begin: bytes, end: bytes, tie: Sequence[Column] = ()) -> DataFrame:
    """Live keys with begin <= key < end, in key order; an empty interval gives no rows."""
    inside = (F.col("key_entry") >= F.lit(bytearray(begin))) & (F.col("key_entry") < F.lit(bytearray(end)))
    return live_view(records.where(inside), tie).orderBy(*KEY)


def dedup_identity(records: DataFrame, arrival: str) -> DataFrame:
    """One row per (store, key, sequence): the first to arrive wins, with the number of further writes."""
    return (
        records.where(valid_record())
        .groupBy(*KEY, "seq_num")
        .agg(F.min(F.struct(arrival, "type", "value_entry")).alias("w"), F.countDistinct(arrival).alias("n"))
        .select(*KEY, "seq_num", f"w.{arrival}", "w.type", "w.value_entry", (F.col("n") - 1).alias("n_rejected"))
    )


def merge_order(runs: DataFrame) -> tuple[DataFrame, list]:
    """Records of several runs and their merge order: key ascending, newest first; at one sequence lower level, newer table."""
    return runs, ["db_id", "key_entry", F.col("seq_num").desc(), "level", F.col("table_id").desc(), "type", "value_entry", "block_no"]


def merge_runs(runs: DataFrame) -> DataFrame:
    """All records of several runs in merge order; nothing is dropped.

    A global sort: Spark range-partitions on store, key and sequence, so one hot key is spread as well.
    """
    rows, order = merge_order(runs)
    return rows.orderBy(*order[:5])


def numbered(rows: DataFrame, order: Sequence) -> DataFrame:
    """Rows with ``position``, 1 for the first in the order, without gathering them.

    They are written range-partitioned and sorted; a row's position is that
    in its partition plus the rows of the partitions before. ``order`` should tell all rows apart.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "numbered")
    parts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"))
    # A row for each partition: a window over them all is small.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_p", (before - F.col("_low") + 1).alias("_from"))
    return join_small(kept, starts, ["_p"], "inner").withColumn("position", F.col("_i") + F.col("_from")).drop("_p", "_i", "_from")


def generations(records: DataFrame, size: int) -> DataFrame:
    """Write generations of ``size`` sequence numbers per store: 1 for 1..size and so on, with counts and bytes."""
    return (
        records.where(valid_record())
        .withColumn("generation_id", F.floor((F.col("seq_num") - 1) / size) + 1)
        .groupBy("db_id", "generation_id")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.min("seq_num").alias("min_seq"),
            F.max("seq_num").alias("max_seq"),
            F.sum(F.octet_length("key_entry") + F.coalesce(F.octet_length("value_entry"), F.lit(0))).alias("n_bytes"),
        )
    )
