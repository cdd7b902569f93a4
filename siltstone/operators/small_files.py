"""Problem 3: far too many small files."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions.expressions import RECORD_HEADER_BYTES, normal_path, record_bytes
from siltstone.functions.joins import join_small
from siltstone.sources.published import Folder
from siltstone.sources.tables import scratch, shared_dir, written

#: Bits of either coordinate; a Hilbert code has twice as many.
COORDINATE_BITS = 16
#: Slices of either coordinate for each square root of a group's files, so a file has about 16 cells of the curve.
SLICES = 4
#: Bytes of the layout (slice keys and cuts) that one pass over the rows may carry; more groups take further passes.
LAYOUT_BYTES = 32 << 20
#: Record bytes a shuffle partition of the rewrite should have.
PARTITION_BYTES = 128 << 20
#: Size of a file where a level has no target.
DEFAULT_TARGET = 128 << 20


def hilbert_codes(x: np.ndarray, y: np.ndarray, bits: int = COORDINATE_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with coordinates of ``bits`` bits, vectorised over the points."""
    x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
    code = np.zeros_like(x)
    for k in range(bits - 1, -1, -1):
        side = np.int64(1) << k
        right, upper = (x >> k) & 1, (y >> k) & 1
        code += side * side * ((3 * right) ^ upper)
        # The quadrant's own curve is turned: flip, then exchange the axes.
        x, y = x & (side - 1), y & (side - 1)
        flip = (upper == 0) & (right == 1)
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        swap = upper == 0
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return code


def newest_files(footers: DataFrame) -> DataFrame:
    """One row per file ever scanned: file, state at its newest scan, newest size that is known.

    Spellings of one path are one file. One aggregation with a map-side
    partial, so a file scanned very often leaves each task as one row. A file
    whose sizes were never readable has a null size; rows with a null path
    name no file.
    """
    return (
        footers.where(F.col("path").isNotNull())
        .select(normal_path("path").alias("file"), "scan_no", "seen_state", "file_size")
        .groupBy("file")
        .agg(
            F.max_by("seen_state", "scan_no").alias("state"),
            F.expr("max_by(file_size, scan_no) FILTER (WHERE file_size IS NOT NULL)").alias("known_size"),
        )
    )


def row_hash(rows: DataFrame, columns: list[str], seed: int = 0) -> Column:
    """64-bit hash over all columns of a row; a mask of the nulls is part of it, since nulls alone don't change a hash."""
    nulls = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(seed << len(columns)))
    return F.xxhash64(*columns, nulls)


def _digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group the number of rows and order-independent sums over ``_h``, in two halves that can't overflow."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor("_h").alias("x"),
        F.sum(F.shiftrightunsigned("_h", 32)).alias("s1"),
        F.sum(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2"),
    )


def _summed() -> list[Column]:
    """Digests of parts added up to digests of their groups."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), wide("s1").alias("s1"), wide("s2").alias("s2")]


def _places(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each of the asked byte strings how many of the ordered ones are not greater."""
    longest = max((len(k) for k in (*ordered, *asked)), default=0)
    # Fixed-width arrays compare in C; very long keys would make them large.
    kind = f"S{max(1, longest)}" if longest <= 256 else object
    return np.searchsorted(ordered.astype(kind), asked.astype(kind), "right")


@dataclass
class Layout:
    """Where the records of some stores and levels (groups) go.

    ``keys`` are group number and key at which a slice of the key order begins,
    ``slices`` the numbers of these slices; ``cuts`` are group number and
    Hilbert code at which the files from ``low`` to ``high`` begin, numbered
    over all groups. All are sorted; sizes follow the number of files.
    """

    keys: np.ndarray
    slices: np.ndarray
    cuts: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def codes(self, place: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Hilbert codes of records by their place (group number and key) and scaled sequence."""
        at = _places(self.keys, place) - 1
        mine = at >= 0
        # A place before its group's first slice key belongs to slice 0.
        mine[mine] = [self.keys[i][:4] == p[:4] for i, p in zip(at[mine], place[mine], strict=True)]
        x = np.zeros(len(place), np.int64)
        x[mine] = self.slices[at[mine]]
        return hilbert_codes(x, y)

    def files(self, group: np.ndarray, code: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The file of each record; ``spread`` picks one where a cell of the curve fills several."""
        at = np.searchsorted(self.cuts, (group << (2 * COORDINATE_BITS)) + code, "right") - 1
        return self.low[at] + spread % (self.high[at] - self.low[at] + 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys with their bytes summed up to chunks of a step: first place, group and bytes of each chunk."""
    for b in batches:
        group, size, step = (b.column(c).to_numpy() for c in ("_g", "_bytes", "_step"))
        begins = np.concatenate([[True], group[1:] != group[:-1]])
        before = np.cumsum(size) - size
        own = before - np.maximum.accumulate(np.where(begins, before, 0))
        number = own // np.maximum(step, 1)
        first = np.flatnonzero(begins | np.concatenate([[True], number[1:] != number[:-1]]))
        if len(first):
            total = np.add.reduceat(size, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[first]), b.column("_place").take(pa.array(first)), pa.array(total)], ["_g", "_place", "_bytes"]
            )


@dataclass
class SmallFiles:
    """Consolidation of a store's many small tables into few files near the target size of their level.

    1. ``small_tables`` are the tables worth it; all others stay as they are.
    2. Their records, each once, are written to a scratch table. What that takes
       on storage for each byte of its records is measured, so that files are
       sized by what they will really take.
    3. A store's level (a group) that needs F > 1 files gets about 4 * sqrt(F)
       slices of equal bytes along its keys (exact: from the bytes of all
       keys), and as many along its sequences. A record's Hilbert code is that
       of its two slices, so a file covers a compact range of both.
    4. The exact byte histogram of all codes is cut into F balanced files; the
       rows are shuffled straight to their file's partition by these cuts, and
       each file is written by one task. A cell of the curve heavier than a
       file (one hot key) is spread over its files by a hash of the record.
    5. Digests over all columns of all rows, of the source on the one side and
       of the files read back on the other, must agree for every store and
       level, else the files are removed and RuntimeError is raised. Only then
       is the version published, with a catalog of the new files.

    Slices and cuts are a few bytes for each file; groups whose layout is more
    than LAYOUT_BYTES together take several passes. Nulls in key or value are
    kept, as is every column of a record; tables without records give no file.
    An empty input writes nothing and gives an empty report.
    """

    catalog: DataFrame
    footers: DataFrame
    run_records: DataFrame
    targets: DataFrame
    layout_bytes: int = LAYOUT_BYTES

    COLUMNS = ("db_id", "table_id", "level", "block_no", "key_entry", "value_entry", "type", "seq_num")

    def _limits(self) -> DataFrame:
        return self.targets.groupBy("level").agg(
            F.max("small_file_size").alias("small_file_size"), F.max("target_file_size").alias("target_file_size")
        )

    def small_tables(self) -> DataFrame:
        """(db_id, table_id, level, known_size, target_file_size) of live tables far below their target, each once.

        A table listed twice, under one path or several, is one table; with a
        null path, a file that is gone or a size never known it is no case.
        """
        listed = (
            self.catalog.where(F.col("path").isNotNull())
            .select("db_id", "table_id", "level", normal_path("path").alias("file"))
            .distinct()
        )
        there = newest_files(self.footers).where((F.col("state") == "present") & F.col("known_size").isNotNull())
        return (
            join_small(listed.join(there, "file"), self._limits(), ["level"], "inner")
            .where(F.col("known_size") < F.col("small_file_size"))
            .groupBy("db_id", "table_id", "level")
            .agg(F.min("known_size").alias("known_size"), F.max("target_file_size").alias("target_file_size"))
        )

    def records(self) -> DataFrame:
        """The records of all live tables without exact repeats."""
        return self._of(self.catalog).distinct()

    def _of(self, tables: DataFrame) -> DataFrame:
        own = tables.select("db_id", "table_id").distinct()
        return join_small(self.run_records.select(*self.COLUMNS), own, ["db_id", "table_id"], "left_semi")

    def _groups(self, staged: DataFrame, stored: float) -> DataFrame:
        """(db_id, _level, n_bytes, n_files, top): bytes of each store and level, the files they need, greatest sequence."""
        limits = self._limits().select(F.col("level").alias("_level"), F.col("target_file_size").alias("_target"))
        totals = staged.groupBy("db_id", "_level").agg(F.sum("_bytes").alias("n_bytes"), F.max("seq_num").alias("top"))
        target = F.greatest(F.coalesce("_target", F.lit(DEFAULT_TARGET)), F.lit(1))
        return join_small(totals, limits, ["_level"], "left").select(
            "db_id", "_level", "n_bytes", F.ceil(F.col("n_bytes") * stored / target).alias("n_files"),
            F.greatest(F.coalesce("top", F.lit(1)), F.lit(1)).alias("top"),
        )

    def _placed(self, staged: DataFrame, groups: DataFrame) -> DataFrame:
        """The staged rows of some groups with group number, place in the key order and scaled sequence."""
        side = 1 << COORDINATE_BITS
        share = F.coalesce(F.col("seq_num"), F.lit(0)) / (F.col("top") + 1)
        # Slices of the sequence are as wide as those of the keys.
        wide = F.lit(side) / F.col("slices")
        y = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(0.999999)) * F.col("slices")) * wide
        place = F.concat(F.unhex(F.lpad(F.hex("_g"), 8, "0")), F.coalesce("key_entry", F.lit(bytearray(b""))))
        return staged.join(F.broadcast(groups), ["db_id", "_level"]).withColumns(
            {"_place": place, "_y": y.cast("bigint"), "_spread": F.pmod(row_hash(staged, list(self.COLUMNS)), F.lit(1 << 31))}
        )

    def _cut(self, staged: DataFrame, groups: DataFrame, table: pa.Table) -> tuple[Layout, DataFrame]:
        """The layout of some groups, a local table of proven size, and the staged rows with their codes."""
        rows = self._placed(staged, groups)
        if table.column("n_files").to_numpy().max() < 2:  # a file a group needs no curve
            none, first = np.zeros(0, np.int64), np.arange(table.num_rows)
            return Layout(np.zeros(0, object), none, first << (2 * COORDINATE_BITS), first, first), rows.withColumn("_code", F.lit(0))
        many = rows.where("n_files > 1")
        # Slices of the keys: bytes of every key, summed up in key order to chunks of an eighth of a slice.
        keyed = many.groupBy("_place", "_g").agg(
            F.sum("_bytes").alias("_bytes"), F.max(F.floor(F.col("n_bytes") / (8 * F.col("slices")))).alias("_step")
        )
        chunks = (
            keyed.repartitionByRange("_place").sortWithinPartitions("_place").mapInArrow(_chunks, "_g bigint, _place binary, _bytes bigint")
        )
        in_group = Window.partitionBy("_g").orderBy("_place")
        before = F.coalesce(F.sum("_bytes").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = groups.select("_g", "n_bytes", "slices")
        cut = (
            chunks.withColumn("_before", before)
            .join(F.broadcast(sizes), "_g")
            .withColumn("slice", F.floor(F.col("_before") * F.col("slices") / F.col("n_bytes")))
            .withColumn("_last", F.lag("slice", 1, 0).over(in_group))
            .where("slice > _last")
            .select("_place", (F.col("slice") * F.lit(1 << COORDINATE_BITS) / F.col("slices")).cast("bigint").alias("slice"))
            .toArrow()
        )
        keys = np.array(cut.column("_place").to_pylist(), dtype=object)
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
        layout = Layout(keys[order], cut.column("slice").to_numpy()[order])
        shared = rows.sparkSession.sparkContext.broadcast(layout)

        @F.pandas_udf(T.LongType())
        def code_of(place: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(shared.value.codes(place.to_numpy(), y.to_numpy().astype(np.int64)))

        # The exact histogram of the codes, cut at equal bytes: cells of one file need one entry.
        cells = many.select("_g", code_of("_place", "_y").alias("_code"), "_bytes").groupBy("_g", "_code").agg(F.sum("_bytes").alias("_bytes"))
        in_group = Window.partitionBy("_g").orderBy("_code")
        before = F.coalesce(F.sum("_bytes").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        low = F.floor(F.col("_before") * F.col("n_files") / F.col("n_bytes"))
        high = F.floor((F.col("_before") + F.col("_bytes")) * F.col("n_files") / F.col("n_bytes")) - 1
        cuts = (
            cells.withColumn("_before", before)
            .join(F.broadcast(groups.select("_g", "n_bytes", "n_files")), "_g")
            .select("_g", "_code", low.alias("low"), F.greatest(low, high).alias("high"))
            .withColumns({"_l": F.lag("low").over(in_group), "_h": F.lag("high").over(in_group)})
            .where("_l IS NULL OR _l <> low OR _h <> high")
            .select("_g", "_code", "low", "high")
            .toArrow()
        )
        g, code, lo, hi = (cuts.column(c).to_numpy() for c in ("_g", "_code", "low", "high"))
        single = table.column("_g").to_numpy()[table.column("n_files").to_numpy() < 2]
        g, code = np.concatenate([g, single]), np.concatenate([code, np.zeros(len(single), np.int64)])
        lo, hi = (np.concatenate([a, np.zeros(len(single), np.int64)]) for a in (lo, hi))
        at = (g << (2 * COORDINATE_BITS)) + code
        order = np.argsort(at)
        first = np.concatenate([[0], np.cumsum(np.maximum(table.column("n_files").to_numpy(), 1))])[g]
        layout = Layout(layout.keys, layout.slices, at[order], (first + lo)[order], (first + hi)[order])
        return layout, rows.withColumn("_code", F.when(F.col("n_files") > 1, code_of("_place", "_y")).otherwise(0))

    def _rewrite(self, staged: DataFrame, table: pa.Table, path: str) -> None:
        """Write the files of some groups, at least one."""
        spark = staged.sparkSession
        n = table.column("n_files").to_numpy()
        slices = [1 << min(COORDINATE_BITS, math.ceil(math.log2(SLICES * math.sqrt(max(1, f))))) for f in n.tolist()]
        table = table.append_column("slices", pa.array(slices, pa.int64()))
        table = table.append_column("_g", pa.array(np.arange(len(n)), pa.int64()))
        groups = spark.createDataFrame(
            table, "db_id bigint, _level int, n_bytes bigint, n_files bigint, top bigint, slices bigint, _g bigint"
        )
        layout, rows = self._cut(staged, groups, table)
        shared = spark.sparkContext.broadcast(layout)

        @F.pandas_udf(T.LongType())
        def file_of(group: pd.Series, code: pd.Series, spread: pd.Series) -> pd.Series:
            return pd.Series(shared.value.files(*(c.to_numpy().astype(np.int64) for c in (group, code, spread))))

        n_files = int(np.maximum(n, 1).sum())
        wanted = math.ceil(int(table.column("n_bytes").to_numpy().sum()) / PARTITION_BYTES)
        parts = min(n_files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted))
        (
            rows.withColumn("file_no", file_of("_g", "_code", "_spread"))
            # Files in the order of their numbers to the partitions: a range shuffle whose bounds are the exact cuts.
            .repartitionById(parts, F.floor(F.col("file_no") * parts / n_files).cast("int"))
            .sortWithinPartitions("db_id", "level", "file_no", "_code", "key_entry", F.col("seq_num").desc())
            .select(*self.COLUMNS, "file_no")
            .write.mode("append").partitionBy("db_id", "level", "file_no").parquet(path)
        )

    def run(self, folder: str | None = None) -> DataFrame:
        """Write and publish the files; the report of every store and level that has live tables.

        db_id, level, n_rows, files_before (small tables with records),
        files_after, files_kept (other live tables, untouched), record_bytes,
        file_bytes_max (real size of the largest new file), files_small (new files
        still below small_file_size: what there is fills no more), whole.
        """
        spark = self.catalog.sparkSession
        out = Folder(spark, folder or f"{shared_dir(spark)}/small-files-{uuid.uuid4().hex}")
        steps = Folder(spark, scratch(spark, "small-files"))
        chosen = written(self.small_tables().select("db_id", "table_id", "level"), "", f"{steps.path}/tables")
        source, columns = self._of(chosen), list(self.COLUMNS)
        staged = written(
            source.distinct().withColumns(
                {"_level": F.coalesce("level", F.lit(-1)), "_bytes": F.coalesce(record_bytes(), F.lit(RECORD_HEADER_BYTES))}
            ),
            "",
            f"{steps.path}/records",
        )
        taken = steps.size("records")
        total = staged.agg(F.sum("_bytes")).first()[0] or 0
        groups = written(self._groups(staged, taken / max(1, total)), "", f"{steps.path}/groups")
        # What a group's layout takes: a cut for each file, a key for each slice.
        weight = 64 + 32 * F.col("n_files") + 96 * SLICES * F.sqrt("n_files")
        passes = math.ceil((groups.agg(F.sum(weight)).first()[0] or 0) / self.layout_bytes)
        path = f"{out.path}/files"
        for k in range(passes):
            share = F.pmod(F.xxhash64("db_id", "_level"), F.lit(passes)) == k
            table = groups.where(share).select("db_id", "_level", "n_bytes", "n_files", "top").toArrow()
            if table.num_rows:
                self._rewrite(staged.where(share), table, path)
        report = self._checked(out, source, chosen, columns, passes)
        steps.delete("")
        return report

    def _checked(self, out: Folder, source: DataFrame, chosen: DataFrame, columns: list[str], passes: int) -> DataFrame:
        """Compare the digests of source and files; publish, or remove the files and raise."""
        spark, by = out.spark, ["db_id", "level"]
        schema = T.StructType([*self.run_records.select(*columns).schema, T.StructField("file_no", T.LongType())])
        files = spark.read.schema(schema).parquet(f"{out.path}/files") if passes else spark.createDataFrame([], schema)
        once = source.select(*by, "table_id", row_hash(source, columns).alias("_h"), row_hash(source, columns, 1).alias("_h2")).distinct()
        before = _digest(once, [*by, "table_id"]).groupBy(*by).agg(*_summed(), F.count(F.lit(1)).alias("files_before"))
        own = ["smallest_key", "largest_key", "min_seq", "max_seq", "record_bytes"]
        read = files.withColumns(
            {
                "_h": row_hash(files, columns),
                "_b": F.coalesce(record_bytes(), F.lit(RECORD_HEADER_BYTES)),
                "_size": F.col("_metadata.file_size") if passes else F.lit(0).cast("bigint"),
            }
        )
        each = read.groupBy(*by, "file_no").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"), F.sum(F.shiftrightunsigned("_h", 32)).alias("s1"),
            F.sum(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2"), F.max("_size").alias("file_size"), F.sum("_b").alias("record_bytes"),
            F.min("key_entry").alias("smallest_key"), F.max("key_entry").alias("largest_key"),
            F.min("seq_num").alias("min_seq"), F.max("seq_num").alias("max_seq"),
        )
        each.write.parquet(f"{out.path}/catalog")
        catalog = spark.read.schema(each.schema).parquet(f"{out.path}/catalog")
        small = join_small(catalog, self._limits().select("level", "small_file_size"), ["level"], "left")
        after = small.groupBy(*by).agg(
            *_summed(),
            F.count(F.lit(1)).alias("files_after"),
            F.sum("record_bytes").alias("record_bytes"),
            F.max("file_size").alias("file_bytes_max"),
            F.sum(F.when(F.col("file_size") < F.col("small_file_size"), 1).otherwise(0)).alias("files_small"),
        )
        live = self.catalog.select(*by, "table_id").distinct()
        kept = live.join(chosen, [*by, "table_id"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("files_kept"))
        # Store and level may be null in a record; as a struct they compare as equal.
        sides = [d.select(F.struct(*by).alias("_by"), *[F.col(c).alias(f"{c}{i}") for c in d.columns if c not in by])
                 for i, d in enumerate((before, after, kept))]
        none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c.rstrip("012"))
        same = [F.col(f"{c}0").eqNullSafe(F.col(f"{c}1")) for c in ("n", "x", "s1", "s2")]
        report = sides[0].join(sides[1], "_by", "full").join(sides[2], "_by", "full").select(
            "_by.*", none("n0").alias("n_rows"), none("files_before0"), none("files_after1"), none("files_kept2"),
            none("record_bytes1"), none("file_bytes_max1"), none("files_small1"),
            (same[0] & same[1] & same[2] & same[3]).alias("whole"),
        )
        report.write.parquet(f"{out.path}/report")
        report = spark.read.schema(report.schema).parquet(f"{out.path}/report")
        if broken := report.where("NOT whole").limit(5).collect():
            out.delete("files")
            raise RuntimeError(f"rows of source and files differ, nothing was published: {broken}")
        out.publish(1, {"files": "files", "catalog": "catalog", "report": "report"})
        return report
