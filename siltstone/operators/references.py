"""Problem 4: references to records that do not exist."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.expressions import normal_path
from siltstone.functions.joins import join_small
from siltstone.operators.small_files import newest_files
from siltstone.sources.tables import written

_PARENT, _REFERENCE = 0, 1
#: Parents a range holds at most, if keys hash evenly: about 100 MB of arrays.
RANGE_ROWS = 1 << 20


class _Range:
    """The parents of one key range as sorted arrays: hashes, keys (Arrow) and positions; no Python object per key."""

    def __init__(self, parents: pa.Table):
        """Rows sorted by hash, key and position."""
        h, at = (parents.column(c).to_numpy() for c in ("_h", "_at"))
        keys = parents.column("_key").cast(pa.large_string()).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        first = np.ones(len(h), bool)
        if len(h) > 1:
            first[1:] = (h[1:] != h[:-1]) | pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        self.hashes, self.keys = h[starts], keys.take(pa.array(starts))
        self.times = np.unique(at)
        self.alive = parents.column("_alive").to_numpy()
        self.place = (np.cumsum(first) - 1) * (len(self.times) + 1) + np.searchsorted(self.times, at, "right")

    def _codes(self, h: np.ndarray, keys: pa.Array) -> np.ndarray:
        """The number of each key among the parents, -1 if there is none: by hash, then compared itself."""
        code = np.full(len(h), -1, np.int64)
        at, rest = np.searchsorted(self.hashes, h), np.arange(len(h))
        while len(rest := rest[(at[rest] < len(self.hashes)) & (self.hashes[np.minimum(at[rest], len(self.hashes) - 1)] == h[rest])]):
            same = pc.equal(self.keys.take(pa.array(at[rest])), keys.take(pa.array(rest))).to_numpy(zero_copy_only=False)
            code[rest[same]] = at[rest[same]]
            rest = rest[~same]  # another key of this hash
            at[rest] += 1
        return code

    def probe(self, h: np.ndarray, keys: pa.Array, at: np.ndarray) -> np.ndarray:
        """For each reference: found, missing, deleted or later; binary searches over the whole batch."""
        verdict = np.full(len(h), "missing", dtype=object)
        if not len(self.hashes):
            return verdict
        code = self._codes(h, keys)
        known = code >= 0
        code, stride = code[known], len(self.times) + 1
        last = np.searchsorted(self.place, code * stride + np.searchsorted(self.times, at[known], "right"), "right") - 1
        before = (last >= 0) & (self.place[last] // stride == code)
        verdict[known] = np.where(before, np.where(self.alive[last], "found", "deleted"), "later")
        return verdict


def _probe_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a range parents sort before references, so the arrays are complete when the first batch probes."""
    held: list[pa.RecordBatch] = []
    parents = None
    for b in batches:
        n = int(np.searchsorted(b.column("_side").to_numpy(), _REFERENCE))
        if n:
            held.append(b.slice(0, n))
        if n < len(b):
            if parents is None:
                parents = _Range(pa.Table.from_batches(held, b.schema))
                held = []
            rest = b.slice(n)
            keys, at = rest.column("_key").cast(pa.large_string()), rest.column("_at").to_numpy()
            found = parents.probe(rest.column("_h").to_numpy(), keys, at)
            missed = pa.array(np.flatnonzero(found != "found"))
            yield pa.RecordBatch.from_arrays(
                [rest.column("_key").take(missed), rest.column("_at").take(missed), pa.array(found, pa.string()).take(missed)],
                names=["_key", "_at", "reason"],
            )


def orphans(references: DataFrame, parents: DataFrame, parent_rows: int | None = None) -> DataFrame:
    """The rows of ``references`` whose parent does not exist, with a ``reason``.

    ``references`` has ``_key`` (string) and ``_at`` (bigint, a position in
    time), ``parents`` has both and ``_alive``: from that position on the key
    exists, or no longer does. A reference is *missing* if its key never
    occurs, *later* if it occurs only after the reference, *deleted* if the
    newest entry not after it is a removal; else it is found. Entries of one key
    at one position: a removal counts over an addition.

    Both sides are reduced to distinct keys and positions first, so a key that
    a third of all rows refer to is probed once. They are then partitioned by
    equal ranges of the key's hash, so ranges are even without sampling; their
    number follows ``parent_rows`` (an upper bound of the parents, counted if not
    given), at most about RANGE_ROWS parents each. A range's parents become
    sorted arrays, and the references are probed in Arrow batches by binary
    search; keys of equal hash are compared themselves. Only misses leave
    Python; they are written once and joined back to their rows, broadcast if
    they are few, else by a sort-merge join in which AQE splits a hot missing key.

    A column ``reason`` of the references is replaced.

    A null key or position refers to nothing and is no orphan; empty strings
    are keys. Without references the result is empty, without parents every
    reference is missing.
    """
    spark = references.sparkSession
    rows = parents.count() if parent_rows is None else parent_rows
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS))
    refs = references.drop("reason").where(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    asked = refs.select("_key", "_at").distinct()
    known = (
        parents.where(F.col("_key").isNotNull() & F.col("_at").isNotNull())
        .groupBy("_key", "_at")
        .agg(F.min("_alive").alias("_alive"))
    )
    h = F.xxhash64("_key")
    sides = known.select("_key", "_at", "_alive", F.lit(_PARENT).alias("_side"), h.alias("_h")).unionByName(
        asked.select("_key", "_at", F.lit(True).alias("_alive"), F.lit(_REFERENCE).alias("_side"), h.alias("_h"))
    )
    share = F.shiftright("_h", 32) + F.lit(1 << 31)  # the upper half of the hash, from 0
    missed = (
        sides.repartitionById(n, F.floor(share * n / F.lit(1 << 32)).cast("int"))
        .sortWithinPartitions("_side", "_h", "_key", "_at")
        .mapInArrow(_probe_ranges, "_key string, _at bigint, reason string")
    )
    return join_small(refs, written(missed, "orphans"), ["_key", "_at"], "inner")


def deleted_table_references(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete rows of synced edits as references, and the tables' comings and goings as parents.

    A table is a key with its store and level; a row that lacks one of the
    three names no table. In an edit deletes come first:
    edit n removes at 2n, adds at 2n + 1, and its deletes look at 2n - 1.
    """
    rows = edits.where((F.col("commit_state") == "synced") & F.col("op").isin("add", "delete")).select(
        F.concat("db_id", F.lit("|"), "table_id", F.lit("|"), "level").alias("_key"),
        "op", "db_id", "edit_no", "table_id", "level", "path", "committed_at",
    )
    events = rows.select(
        "_key",
        (F.col("edit_no") * 2 + F.when(F.col("op") == "add", 1).otherwise(0)).alias("_at"),
        (F.col("op") == "add").alias("_alive"),
    )
    deletes = (
        rows.where(F.col("op") == "delete")
        .select("_key", (F.col("edit_no") * 2 - 1).alias("_at"), "db_id", "edit_no", "table_id", "level", "committed_at")
        .distinct()
    )
    return deletes, events


def table_path_references(catalog: DataFrame, footers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of the catalog as references, repeats too, files by their newest scan as parents (times play no part)."""
    refs = (
        catalog.where(F.col("path").isNotNull())
        .select(normal_path("path").alias("_key"), F.lit(0).cast("bigint").alias("_at"), "db_id", "edit_no", "table_id", "committed_at")
    )
    files = newest_files(footers).select(
        F.col("file").alias("_key"), F.lit(0).cast("bigint").alias("_at"), (F.col("state") == "present").alias("_alive")
    )
    return refs, files


def orphan_rows(edits: DataFrame, catalog: DataFrame, footers: DataFrame) -> DataFrame:
    """All orphan references of a fleet, each once: ref_kind, db_id, edit_no, table_id, level, file, committed_at, reason.

    level tells deletes of one table at several levels apart, file (the
    normalised path) several dangling paths of one table; the other kind has
    null there. Different delete rows of one table in one edit: the first (by
    time, null last) takes effect if the table is live, each further one finds
    nothing left and is an orphan as well.
    """
    deletes, events = deleted_table_references(edits)
    paths, files = table_path_references(catalog, footers)
    # Both kinds are probed in one pass; the kind is part of the key.
    own = lambda df, kind: df.withColumn("ref_kind", F.lit(kind)).withColumn("_key", F.concat(F.lit(kind + "|"), "_key"))
    cols = ["ref_kind", "db_id", "edit_no", "table_id", "level", "file", "committed_at"]
    deletes = deletes.withColumn("file", F.lit(None).cast("string"))
    paths = paths.withColumns({"level": F.lit(None).cast("int"), "file": F.col("_key")})
    missed = orphans(
        own(deletes, "deleted_table").unionByName(own(paths, "table_path")),
        own(events, "deleted_table").unionByName(own(files, "table_path")).drop("ref_kind"),
        edits.count() + footers.count(),
    ).select(*cols, "reason")
    in_edit = Window.partitionBy("_key", "edit_no").orderBy(F.col("committed_at").asc_nulls_last())
    again = (
        deletes.where(F.col("_key").isNotNull())
        .withColumn("n", F.row_number().over(in_edit))
        .where("n > 1")
        .select(F.lit("deleted_table").alias("ref_kind"), *cols[1:], F.lit("deleted").alias("reason"))
    )
    # Rows of both sides are one; the probe's own reason, if another, sorts after "deleted".
    return missed.unionByName(again).groupBy(*cols).agg(F.max("reason").alias("reason"))


def orphan_counts(edits: DataFrame, catalog: DataFrame, footers: DataFrame) -> DataFrame:
    """Orphans per referring table and month of committed_at; a null time is a period of its own."""
    return (
        orphan_rows(edits, catalog, footers)
        .groupBy(
            F.when(F.col("ref_kind") == "deleted_table", "manifest_edits").otherwise("table_meta").alias("referring_table"),
            "ref_kind",
            F.date_format("committed_at", "yyyy-MM").alias("month"),
        )
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )
