"""Column expressions shared by the operators; all stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Bloom section format: 128 byte slots, 2 hashes.
BLOOM_SLOTS = 128
BLOOM_HASHES = 2
# Fixed values of the block format: block header, record header, block size.
BLOCK_HEADER_BYTES = 9
RECORD_HEADER_BYTES = 25
BLOCK_BYTES = 4096


def valid_record(kind: str = "type", seq: str = "seq_num", key: str = "key_entry") -> Column:
    """True for a put (0) or tombstone (1) with a positive sequence and a key; a filter that reaches the Parquet scan.

    Null where type or sequence is, so use it to filter only.
    """
    return F.col(kind).isin(0, 1) & (F.col(seq) > 0) & F.col(key).isNotNull()


def key_hex(key: str | Column = "key_entry") -> Column:
    """Upper-case hexadecimal of a key, '' for the empty one."""
    return F.hex(key)


def normal_path(path: str | Column) -> Column:
    """A path with ``\\`` read as ``/`` and empty, ``.`` and ``..`` segments resolved.

    A ``..`` with nothing before it is dropped. Null stays null. Paths without
    such segments, nearly all, skip the fold over the segments.
    """
    p = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    parts = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda seen, part: F.when(part.isin("", "."), seen)
        .when(part == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.array_append(seen, part)),
    )
    return F.when(p.rlike(r"(^|/)(\.{0,2})(/|$)"), F.array_join(parts, "/")).otherwise(p)


def key_bytes(key: str | Column) -> Column:
    """The bytes of a binary key as an array of ints; empty for the empty key."""
    c = F.col(key) if isinstance(key, str) else key
    chars = F.split(F.decode(c, "ISO-8859-1"), "")
    return F.when(F.octet_length(c) > 0, F.transform(chars, lambda x: F.ascii(x))).when(
        c.isNotNull(), F.array().cast("array<int>")
    )


def bloom_slots(key: str | Column) -> Column:
    """The two slots of a key in a 128-slot filter, as array<int>.

    The full definition hashes with 64-bit FNV-1a under two seeds and takes
    ``h1 + i * h2`` modulo 128. Only the low seven bits of either hash can
    reach the result, so the fold keeps just those; no overflow can occur.
    """
    data = key_bytes(key)

    def low_bits(start: int) -> Column:
        return F.aggregate(data, F.lit(start), lambda h, b: ((h.bitwiseXOR(b.bitwiseAND(127))) * 51) % BLOOM_SLOTS)

    # Low seven bits of the FNV offset basis xor either seed.
    pair = F.struct(low_bits(48).alias("a"), low_bits(106).alias("b"))
    return F.transform(F.array(pair), lambda p: F.array(p["a"], (p["a"] + p["b"]) % BLOOM_SLOTS))[0]


def record_bytes(key: str = "key_entry", value: str = "value_entry", overhead: int = RECORD_HEADER_BYTES) -> Column:
    """Stored size of a record; a null value counts as empty."""
    return (F.lit(overhead) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def little_endian(value: str | Column, n_bytes: int) -> Column:
    """The low bytes of a non-negative number, least significant first."""
    digits = F.lpad(F.hex(F.col(value) if isinstance(value, str) else value), 2 * n_bytes, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n_bytes, 0, -1)]))


def from_little_endian(data: str | Column, start: int, n_bytes: int) -> Column:
    """The unsigned number in some bytes, counted from 1, of binary data."""
    digits = F.hex(F.substring(data, start, n_bytes))
    return F.conv(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n_bytes, 0, -1)]), 16, 10).cast("bigint")
