"""The write-ahead log: records to fragments and back, as DataFrames and, for a store's own log, as bytes.

A record's payload is 8 bytes of lengths, key and value. A log file starts
with a header; fragments never cross a block boundary, and a block whose rest
can't hold a fragment header and one byte is padded. Header and fragments
carry a CRC-32 over everything that follows it in them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.expressions import from_little_endian, little_endian
from siltstone.functions.joins import join_small
from siltstone.operators.runs import fold_sorted

# Fixed values of the log format.
FILE_HEADER_BYTES = 40
FRAGMENT_HEADER_BYTES = 22
LOG_BLOCK_BYTES = 4096
FULL, FIRST, MIDDLE, LAST = 0, 1, 2, 3
VERSION = 1

MAGIC = b"SLOG"
_FILE = struct.Struct("<4sIIQQII")  # magic, version, header size, log id, first sequence, block size, reserved; then the CRC
_FRAGMENT = struct.Struct("<IBBQI")  # header size, fragment type, record type, sequence, payload size; before it the CRC

FILE = ["db_id", "wal_id"]


def _start(offset: int, block_bytes: int) -> int:
    """Where the next fragment may begin."""
    room = block_bytes - offset % block_bytes
    return offset + room if room < FRAGMENT_HEADER_BYTES + 1 else offset


def _checksum(size: Column) -> Column:
    head = F.concat(
        little_endian(F.lit(FRAGMENT_HEADER_BYTES), 4), little_endian("frag_type", 1), little_endian("type", 1),
        little_endian("seq_num", 8), little_endian(size, 4),
    )
    return F.crc32(F.concat(head, "payload"))


def to_fragments(records: DataFrame, order: list[str], block_bytes: int = LOG_BLOCK_BYTES) -> DataFrame:
    """Fragments of every record at their offsets in its log file.

    db_id, wal_id, offset, seq_num, type, frag_type, frag_no, payload, checksum.

    Only where a record begins is sequential: that fold sees nothing but sizes.
    Cutting and checksums are column expressions. Files are bounded by the log's size
    limit and spread over tasks. Null values count as empty; records without a key are left out.
    """
    value = F.coalesce("value_entry", F.lit(bytearray(b"")))
    lengths = F.concat(little_endian(F.octet_length("key_entry"), 4), little_endian(F.octet_length(value), 4))
    keyed = records.where(F.col("key_entry").isNotNull())
    rows = keyed.select(*dict.fromkeys([*FILE, *order, "seq_num", "type"]), F.concat(lengths, "key_entry", value).alias("_whole"))
    sized = rows.withColumn("_size", F.octet_length("_whole").cast("bigint"))
    most = block_bytes - FRAGMENT_HEADER_BYTES

    def step(offset, size, _):
        at = _start(FILE_HEADER_BYTES if offset is None else offset, block_bytes)
        rest = size - min(size, block_bytes - at % block_bytes - FRAGMENT_HEADER_BYTES)
        if not rest:
            return at + FRAGMENT_HEADER_BYTES + size, at
        blocks = -(-rest // most)
        return (at // block_bytes + blocks) * block_bytes + FRAGMENT_HEADER_BYTES + rest - (blocks - 1) * most, at

    placed = fold_sorted(sized, FILE, order, "_size", step, "_at")
    first = F.least(F.col("_size"), F.lit(block_bytes) - F.col("_at") % block_bytes - FRAGMENT_HEADER_BYTES)
    more = F.ceil((F.col("_size") - first) / most)
    each = placed.withColumns({"_first": first, "_more": more}).withColumn(
        "frag_no", F.explode(F.sequence(F.lit(0), F.col("_more").cast("int")))
    )
    begins = F.col("frag_no") == 0
    skipped = F.when(begins, 0).otherwise(F.col("_first") + (F.col("frag_no") - 1) * most).cast("int")
    size = F.when(begins, F.col("_first")).otherwise(F.least(F.col("_size") - skipped, F.lit(most))).cast("int")
    shape = F.when(begins, F.when(F.col("_more") == 0, FULL).otherwise(FIRST)).when(F.col("frag_no") == F.col("_more"), LAST).otherwise(MIDDLE)
    offset = F.when(begins, F.col("_at")).otherwise((F.floor(F.col("_at") / block_bytes) + F.col("frag_no")) * block_bytes)
    cut = each.select(
        *FILE, offset.cast("bigint").alias("offset"), F.col("seq_num").cast("bigint").alias("seq_num"), F.col("type").cast("int").alias("type"),
        shape.cast("int").alias("frag_type"), "frag_no", F.substring("_whole", skipped + 1, size).alias("payload"),
    )
    return cut.withColumn("checksum", _checksum(F.octet_length("payload")))


def to_records(fragments: DataFrame, headers: DataFrame | None = None, stop: bool = True) -> DataFrame:
    """Records put together from fragments in offset order, with ``corruption`` (null where whole).

    db_id, wal_id, offset, seq_num, type, key_entry, value_entry, corruption.

    FULL stands alone; FIRST (MIDDLE)* LAST belong together. Damage:
    bad_checksum, no_beginning, mixed (sequence or type changes), unfinished,
    bad_length, bad_header (``headers`` given, and the file has none of version
    1: nothing of it is read). With ``stop`` a file is read up to its first
    damage, which is reported at its offset; without it reading goes on with
    the next beginning. A record cut off at the end of its file is a torn tail,
    not damage: it never was acknowledged, and is left out.

    One shuffle by file: windows and groups run over the fragments of one log
    file, whose size the log limits; fragments without ``checksum`` aren't checked.
    """
    known = "checksum" in fragments.columns
    fine = F.coalesce(_checksum(F.octet_length("payload")) == F.col("checksum"), F.lit(False)) if known else F.lit(True)
    in_file = Window.partitionBy(*FILE).orderBy("offset")
    ended = F.coalesce(F.lag("frag_type").over(in_file).isin(FULL, LAST), F.lit(False))
    begins = F.col("frag_type").isin(FULL, FIRST) | ended
    one = F.struct("offset", "frag_type", "seq_num", "type", fine.alias("fine"), "payload")
    runs = (
        fragments.withColumn("_run", F.sum(begins.cast("int")).over(in_file))
        .groupBy(*FILE, "_run")
        .agg(F.sort_array(F.collect_list(one)).alias("_f"))
    )
    whole = F.aggregate("_f", F.lit(bytearray(b"")), lambda seen, x: F.concat(seen, x["payload"]))
    head, tail = F.element_at("_f", 1), F.element_at("_f", -1)
    n, m = from_little_endian("_w", 1, 4), from_little_endian("_w", 5, 4)
    damage = (
        F.when(F.exists("_f", lambda x: ~x["fine"]), "bad_checksum")
        .when(~head["frag_type"].isin(FULL, FIRST), "no_beginning")
        .when(F.exists("_f", lambda x: (x["seq_num"] != head["seq_num"]) | (x["type"] != head["type"])), "mixed")
        .when(~tail["frag_type"].isin(FULL, LAST), "unfinished")
        .when((F.octet_length("_w") < 8) | (F.octet_length("_w") != 8 + n + m), "bad_length")
    )
    last = F.max("offset").over(Window.partitionBy(*FILE))
    parts = runs.withColumn("_w", whole).select(
        *FILE, head["offset"].alias("offset"), head["seq_num"].alias("seq_num"), head["type"].alias("type"), "_w", n.alias("_n"),
        damage.alias("corruption"),
    )
    seen = parts.withColumns(
        {"_last": last, "_bad": F.min(F.when(F.col("corruption").isNotNull(), F.col("offset"))).over(Window.partitionBy(*FILE))}
    )
    torn = F.coalesce((F.col("corruption") == "unfinished") & (F.col("offset") == F.col("_last")), F.lit(False))
    kept = seen.where(~torn)
    if stop:
        kept = kept.where(F.col("_bad").isNull() | (F.col("offset") <= F.col("_bad")))
    whole_one = F.col("corruption").isNull()
    out = kept.select(
        *FILE, "offset", "seq_num", "type",
        F.when(whole_one, F.substring("_w", F.lit(9), F.col("_n").cast("int"))).alias("key_entry"),
        F.when(whole_one, F.substring("_w", (F.col("_n") + 9).cast("int"), F.octet_length("_w"))).alias("value_entry"),
        "corruption",
    )
    if headers is None:
        return out
    good = headers.where(F.col("version") == VERSION).select(*FILE).distinct().withColumn("_good", F.lit(True))
    checked = join_small(out, good, FILE, "left")
    missing = (
        join_small(fragments.select(*FILE).distinct(), good, FILE, "left_anti")
        .select(*FILE, F.lit(0).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("seq_num"), F.lit(None).cast("int").alias("type"),
                F.lit(None).cast("binary").alias("key_entry"), F.lit(None).cast("binary").alias("value_entry"), F.lit("bad_header").alias("corruption"))
    )
    return checked.where("_good").drop("_good").unionByName(missing)


def fragment_stats(fragments: DataFrame) -> DataFrame:
    """Fragments of each log file: how many, how many split, payload bytes."""
    return fragments.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.sum(F.when(F.col("frag_type") == FIRST, 1).otherwise(0)).alias("n_split"),
        F.sum(F.octet_length("payload")).alias("payload_bytes"),
    )


# The log of one store, written record by record


def file_header(wal_id: int, start_seq: int, block_bytes: int = LOG_BLOCK_BYTES) -> bytes:
    """The 40 bytes a log file begins with."""
    head = _FILE.pack(MAGIC, VERSION, FILE_HEADER_BYTES, wal_id, start_seq, block_bytes, 0)
    return head + struct.pack("<I", zlib.crc32(head))


def encode(key: bytes, value: bytes, kind: int, seq: int, offset: int, block_bytes: int = LOG_BLOCK_BYTES) -> bytes:
    """The bytes that append a record at an offset of its file, padding included."""
    rest = struct.pack("<II", len(key), len(value)) + key + value
    out, no = bytearray(), 0
    while rest:
        at = _start(offset + len(out), block_bytes)
        out += b"\0" * (at - offset - len(out))
        room = block_bytes - at % block_bytes - FRAGMENT_HEADER_BYTES
        part, rest = rest[:room], rest[room:]
        shape = (FIRST if rest else FULL) if not no else (MIDDLE if rest else LAST)
        body = _FRAGMENT.pack(FRAGMENT_HEADER_BYTES, shape, kind, seq, len(part)) + part
        out += struct.pack("<I", zlib.crc32(body)) + body
        no += 1
    return bytes(out)


@dataclass
class Recovered:
    """What a log file held: (key, value, kind, sequence) of its records, where the last whole one ends, the damage met there."""

    records: list[tuple[bytes, bytes, int, int]]
    end: int
    corruption: str | None


def decode(data: bytes, wal_id: int) -> Recovered:
    """The records of a log file up to a torn tail (no damage: it was never acknowledged) or the first damage."""
    if len(data) < FILE_HEADER_BYTES:
        return Recovered([], 0, None)
    magic, version, size, own, _, block, _ = _FILE.unpack_from(data)
    crc = struct.unpack_from("<I", data, _FILE.size)[0]
    if crc != zlib.crc32(data[: _FILE.size]) or (magic, version, size) != (MAGIC, VERSION, FILE_HEADER_BYTES) or own != wal_id:
        return Recovered([], 0, "bad_header")
    out = Recovered([], FILE_HEADER_BYTES, None)
    parts, head = [], None
    for shape, kind, seq, part, end in _scan(data, block):
        if shape is None:
            out.corruption = part
            return out
        if (shape in (FULL, FIRST)) == bool(parts):
            out.corruption = "unfinished" if parts else "no_beginning"
            return out
        if parts and (kind, seq) != head:
            out.corruption = "mixed"
            return out
        parts, head = [*parts, part], (kind, seq)
        if shape in (FULL, LAST):
            whole = b"".join(parts)
            n, m = struct.unpack_from("<II", whole) if len(whole) >= 8 else (-1, -1)
            if len(whole) != 8 + n + m:
                out.corruption = "bad_length"
                return out
            out.records.append((whole[8 : 8 + n], whole[8 + n :], kind, seq))
            out.end, parts = end, []
    return out


def _scan(data: bytes, block_bytes: int) -> Iterator[tuple]:
    """Fragments (type, record type, sequence, payload, end) of a file; a damaged one ends it as (None, .., damage, ..)."""
    at = _start(FILE_HEADER_BYTES, block_bytes)
    while at + FRAGMENT_HEADER_BYTES <= len(data):
        crc = struct.unpack_from("<I", data, at)[0]
        size, shape, kind, seq, n = _FRAGMENT.unpack_from(data, at + 4)
        end = at + FRAGMENT_HEADER_BYTES + n
        if size != FRAGMENT_HEADER_BYTES or shape > LAST or kind > 1 or end > at - at % block_bytes + block_bytes:
            yield None, None, None, "bad_fragment", at
            return
        if end > len(data):
            return
        if crc != zlib.crc32(data[at + 4 : end]):
            yield None, None, None, "bad_checksum", at
            return
        yield shape, kind, seq, data[at + FRAGMENT_HEADER_BYTES : end], end
        at = _start(end, block_bytes)
