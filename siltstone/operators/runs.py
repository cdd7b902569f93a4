"""Sorted runs: block packing, statistics, block index and Bloom sections of table files.

Records carry db_id, table_id, level, block_no, key_entry, value_entry, type,
seq_num. A table file is bounded by the target size of its level, so work
per table is bounded too; nothing here gathers a store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.expressions import (
    BLOCK_BYTES,
    BLOCK_HEADER_BYTES,
    BLOOM_HASHES,
    BLOOM_SLOTS,
    bloom_slots,
    record_bytes,
)
from siltstone.functions.joins import join_small

TABLE = ["db_id", "table_id"]


def fold_sorted(
    rows: DataFrame, group: list[str], order: list, size: str, step: Callable, out: str, key: str | None = None
) -> DataFrame:
    """A sequential fold over each group in order, as ``out`` (bigint) beside every row.

    ``step(state, size, key_changed) -> (state, result)`` starts from None in
    each group; ``key_changed`` is about column ``key``, if given. Groups are
    hash-partitioned and sorted by Spark (spilling as needed) and streamed
    through Arrow batches, of which only group, size and key become Python
    values; only the state of the current group is held. Callers select what they need beforehand.
    """
    sized = rows.drop(out).repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([*sized.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = state = None
        for b in batches:
            groups = zip(*(b.column(g).to_pylist() for g in group), strict=True)
            keys = b.column(key).to_pylist() if key else [None] * len(b)
            results = []
            for g, k, n in zip(groups, keys, b.column(size).to_pylist(), strict=True):
                if g != at:
                    at, state, last = g, None, None
                state, r = step(state, n, k != last)
                last = k
                results.append(r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.int64())], [*b.schema.names, out])

    return sized.mapInArrow(run, schema)


def _sizes(runs: DataFrame) -> DataFrame:
    """What packing needs of each record: no value moves."""
    return runs.select(*TABLE, "key_entry", "seq_num", record_bytes().alias("record_size"))


def pack_blocks(runs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Greedy block packing of each table: db_id, table_id, key_entry, seq_num, record_size, packed_block of every record.

    A record joins the current block if header, earlier records and the record
    fit into ``block_bytes``, else it opens the next one. A record too large
    for an empty block gets block -1 (it would be rejected) and changes nothing.
    """

    def step(state, n, _):
        block, used = state or (0, BLOCK_HEADER_BYTES)
        if BLOCK_HEADER_BYTES + n > block_bytes:
            return (block, used), -1
        if used + n > block_bytes:
            block, used = block + 1, BLOCK_HEADER_BYTES
        return (block, used + n), block

    return fold_sorted(_sizes(runs), TABLE, ["key_entry", F.col("seq_num").desc(), "record_size"], "record_size", step, "packed_block")


def split_outputs(runs: DataFrame, max_bytes: int) -> DataFrame:
    """Output files of each table: db_id, table_id, key_entry, seq_num, record_size, file_no of every record.

    The next file starts once the current one holds ``max_bytes`` or more, and
    only where the key changes: the versions of a key never straddle two files.
    """

    def step(state, n, key_changed):
        no, used = state or (0, 0)
        if key_changed and used >= max_bytes:
            no, used = no + 1, 0
        return (no, used + n), no

    order = ["key_entry", F.col("seq_num").desc(), "record_size"]
    return fold_sorted(_sizes(runs), TABLE, order, "record_size", step, "file_no", "key_entry")


def table_stats(runs: DataFrame) -> DataFrame:
    """Statistics of each table as its metadata holds them."""
    return runs.groupBy(*TABLE, "level").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(F.when(F.col("type") == 1, 1).otherwise(0)).alias("tombstone_count"),
        F.min("seq_num").alias("min_seq"),
        F.max("seq_num").alias("max_seq"),
        F.min("key_entry").alias("smallest_key"),
        F.max("key_entry").alias("largest_key"),
        F.countDistinct("block_no").alias("data_block_count"),
        F.sum(record_bytes()).alias("record_bytes"),
    )


def estimate_size(runs: DataFrame) -> DataFrame:
    """Estimated bytes of the records of each table, by the builder's own formula (9 bytes beside key and value)."""
    return runs.groupBy(*TABLE).agg(F.sum(record_bytes(overhead=BLOCK_HEADER_BYTES)).alias("estimated_bytes"))


def block_index(runs: DataFrame) -> DataFrame:
    """First and last key of each block."""
    return runs.groupBy(*TABLE, "block_no").agg(
        F.min("key_entry").alias("first_key"), F.max("key_entry").alias("last_key"), F.count(F.lit(1)).alias("n_records")
    )


def index_candidates(index: DataFrame, key: bytes) -> DataFrame:
    """Per table the blocks that may hold a key: first and last block number, none for a miss."""
    k = F.lit(bytearray(key))
    return (
        index.where((F.col("first_key") <= k) & (F.col("last_key") >= k))
        .groupBy(*TABLE)
        .agg(F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"))
    )


def table_get(runs: DataFrame, key: bytes) -> DataFrame:
    """The newest version of a key in each table that has it, tombstones included."""
    return (
        runs.where(F.col("key_entry") == F.lit(bytearray(key)))
        .groupBy(*TABLE)
        .agg(F.max(F.struct("seq_num", "type", "value_entry")).alias("w"))
        .select(*TABLE, "w.seq_num", "w.type", "w.value_entry")
    )


def bloom_build(runs: DataFrame) -> DataFrame:
    """Bloom section of each table: key_count (records, not distinct keys) and the set slots, ascending.

    At most 128 slots a table, gathered with a map-side partial.
    """
    slots = runs.withColumn("_s", bloom_slots("key_entry"))
    return slots.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("key_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_s")))).alias("slots"),
    )


def bloom_valid() -> Column:
    """Whether a stored section's payload is well formed; null counts as malformed."""
    mask = F.hex("mask")
    return F.coalesce(
        (F.octet_length("mask") == BLOOM_SLOTS)
        & (F.col("bloom_bits") == BLOOM_SLOTS)
        & (F.col("hash_count") == BLOOM_HASHES)
        & mask.rlike("^(0[01])*$"),
        F.lit(False),
    )


def bloom_probe(sections: DataFrame, key: bytes) -> DataFrame:
    """Per section whether it may contain a key; a malformed section always may."""
    slots = bloom_slots(F.lit(bytearray(key)))
    byte = lambda s: F.substring(F.hex("mask"), s * 2 + 2, F.lit(1))
    both = (byte(slots[0]) == "1") & (byte(slots[1]) == "1")
    return sections.select(*TABLE, F.when(bloom_valid(), F.coalesce(both, F.lit(False))).otherwise(True).alias("may_contain"))


def pruned_get(runs: DataFrame, candidates: DataFrame, sections: DataFrame, key: bytes) -> DataFrame:
    """The newest version of a key in every store, from the tables that may hold it alone.

    ``candidates`` (db_id, table_id) are the tables whose key range holds the
    key; of these, tables whose stored Bloom section denies it are left out (no
    section, or a malformed one, denies nothing). db_id, n_in_range, n_probed,
    seq_num, type, value_entry (null where no table has the key). Stores
    without a table in range are absent. The key's equality reaches the scan,
    and where tables are files, only those of the probed ones are opened.
    """
    may = bloom_probe(sections, key).groupBy(*TABLE).agg(F.max("may_contain").alias("_may"))
    ranged = candidates.select(*TABLE).distinct().join(may, TABLE, "left").withColumn("_may", F.coalesce("_may", F.lit(True)))
    stores = ranged.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_in_range"), F.sum(F.col("_may").cast("int")).alias("n_probed"))
    hits = join_small(runs.where(F.col("key_entry") == F.lit(bytearray(key))), ranged.where("_may").select(*TABLE), TABLE, "left_semi")
    newest = hits.groupBy("db_id").agg(F.max(F.struct("seq_num", -F.col("level"), "table_id", "type", "value_entry")).alias("w"))
    return stores.join(newest, "db_id", "left").select("db_id", "n_in_range", "n_probed", "w.seq_num", "w.type", "w.value_entry")


def record_checksums(runs: DataFrame) -> DataFrame:
    """CRC-32 of key and value bytes, combined per block as count and sum; detects any changed record."""
    both = F.concat("key_entry", F.coalesce("value_entry", F.lit(bytearray(b""))))
    return runs.groupBy(*TABLE, "block_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.crc32(both)).alias("crc_sum"))


