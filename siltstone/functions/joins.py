"""Joins whose physical form follows a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is broadcast.
BROADCAST_BYTES = 8 << 20
#: What a row costs beside its values.
ROW_BYTES = 16


def _fixed_width(schema: T.StructType) -> int | None:
    """Bytes of a row if all its columns have a fixed width, else None."""
    fixed = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DoubleType, T.FloatType, T.DateType,
             T.TimestampType, T.TimestampNTZType)
    return ROW_BYTES + 8 * len(schema) if all(isinstance(f.dataType, fixed) for f in schema) else None


def bounded(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """A table proven to be at most ``max_bytes``, None if it is larger; runs a job.

    Rows of fixed width are fetched as Arrow up to the bound, and the result is
    a local table of them, so nothing is computed again. With columns of other
    types the bytes are summed up first; such a table should be a written one.
    """
    width = _fixed_width(small.schema)
    if width is None:
        sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if not isinstance(f.dataType, T.BinaryType)
                 else F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in small.schema]
        each = sum(sizes, F.lit(ROW_BYTES + 8 * len(sizes)).cast("bigint"))
        return small if (small.agg(F.sum(each)).first()[0] or 0) <= max_bytes else None
    most = max(1, max_bytes // width)
    rows = small.limit(most + 1).toArrow()
    return small.sparkSession.createDataFrame(rows, small.schema) if rows.num_rows <= most else None


def join_small(
    large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join a large table with one that is expected to be small, whatever the skew of the key.

    A small side of at most ``max_bytes``, which is measured (see ``bounded``),
    is broadcast and the large side does not move. Beyond that it is a sort-merge
    join, never a broadcast: both sides shuffle on the key, nothing is
    replicated up front, and where one key holds a large part of the rows AQE
    splits its partition. ``how`` is inner, left, left_semi or left_anti; null
    keys match nothing. Columns of both sides beside the keys are an error.
    """
    twice = set(large.columns) & set(small.columns) - set(on)
    if twice and how in ("inner", "left"):
        raise ValueError(f"columns of both sides: {sorted(twice)}")
    if (local := bounded(small, max_bytes)) is not None:
        return large.join(F.broadcast(local), list(on), how)
    return large.hint("merge").join(small.hint("merge"), list(on), how)
