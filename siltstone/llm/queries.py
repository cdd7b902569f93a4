"""The registered queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.mojibake import Mojibake
from siltstone.llm.packing import fill_report, pack
from siltstone.llm.seen import first_arrivals, section_answers, section_report, seen_before, wrong_answers
from siltstone.llm.tokens import count_tokens, encode_documents
from siltstone.sources.tables import load, written


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals whose key occurred before in their store: in_no."""
    return seen_before(load(spark, d, "run_records"), load(spark, d, "incoming_records"))


def p5_wrong(spark: SparkSession, d: str) -> DataFrame:
    """Share of wrong answers of the chain and of the stored table sections."""
    return wrong_answers(*(load(spark, d, t) for t in ("run_records", "incoming_records", "bloom_sections")))


def p5_section_share(spark: SparkSession, d: str) -> DataFrame:
    """The row of the stored table sections, which SQL can tell as well."""
    said = section_report(*(load(spark, d, t) for t in ("run_records", "incoming_records", "bloom_sections")))
    return said.drop("bound")


def p5_sections(spark: SparkSession, d: str) -> DataFrame:
    """What the stored sections of its store say about each arriving key."""
    said = section_answers(load(spark, d, "bloom_sections"), first_arrivals(load(spark, d, "incoming_records")))
    return said.select("db_id", F.hex("key_entry").alias("key_hex"), "maybe")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encode_documents(load(spark, d, "documents"))


def _capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The permitted sizes: a fixed table of a few rows."""
    rows = load(spark, d, "pack_sizes").where("capacity_tokens > 0").distinct().collect()
    return sorted(((r["pack_kind"], r["capacity_tokens"]) for r in rows), key=lambda r: r[1])


def _counted(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Tokens of every document, counted once and written, and the number of documents."""
    items = written(count_tokens(load(spark, d, "documents")), "token-counts")
    return items, items.count()


def _jointly(items: DataFrame, rows: int, kinds: list[tuple[str, int]]) -> DataFrame:
    packed = pack(items, [c for _, c in kinds], rows=rows)
    kind = F.create_map(*[x for k, c in kinds for x in (F.lit(c), F.lit(k))])[F.col("capacity")]
    return packed.withColumn("pack_kind", kind)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of the permitted sizes, chosen jointly."""
    return _jointly(*_counted(spark, d), _capacities(spark, d))


def _each(items: DataFrame, rows: int, kinds: list[tuple[str, int]]) -> DataFrame:
    out = None
    for kind, capacity in kinds:
        one = pack(items, [capacity], rows=rows).withColumn("pack_kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def p7_each(spark: SparkSession, d: str) -> DataFrame:
    """All documents once in containers of each size alone: one packing per pack_kind."""
    return _each(*_counted(spark, d), _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused share by size, of the joint packing and of each size alone."""
    items, rows, kinds = *_counted(spark, d), _capacities(spark, d)
    joint = _jointly(items, rows, kinds).withColumn("packing", F.lit("joint"))
    return fill_report(joint.unionByName(_each(items, rows, kinds).withColumn("packing", F.lit("alone"))), ["packing", "pack_kind"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage that was decoded with a wrong encoding: doc_id."""
    return Mojibake(load(spark, d, "documents")).found()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The documents found, with the originals put in where nothing was lost."""
    return Mojibake(load(spark, d, "documents")).restored()


QUERIES = {
    f.__name__: f
    for f in (p5_found, p5_wrong, p5_sections, p5_section_share, p6_ids, p7_pack, p7_each, p7_fill, p8_found, p8_restored)
}

_FNV = lambda start: f"""list_reduce(list_prepend({start}::INTEGER, list_transform(range(0, octet_length(key_entry)),
  lambda i: ((strpos('0123456789ABCDEF', substr(hex(key_entry), 2 * i + 1, 1)) - 1) % 8 * 16
             + strpos('0123456789ABCDEF', substr(hex(key_entry), 2 * i + 2, 1)) - 1)::INTEGER)),
  lambda h, b: (xor(h, b) * 51 % 128)::INTEGER)"""  # noqa: E731

_SECTIONS = f"""hashed AS (SELECT *, {_FNV(48)} AS a, {_FNV(106)} AS b FROM keys),
sections AS (
  SELECT db_id, hex(mask) AS m, coalesce(octet_length(mask) = 128 AND bloom_bits = 128 AND hash_count = 2
    AND regexp_matches(hex(mask), '^(0[01])*$'), false) AS good FROM bloom_sections)"""
_MAYBE = """coalesce(bool_or(NOT good OR (substr(m, 2 * a + 2, 1) = '1'
  AND substr(m, 2 * ((a + b) % 128) + 2, 1) = '1')), false) AS maybe"""

ORACLE = {
    "p5_found": """WITH first AS (
  SELECT db_id, key_entry, min(in_no) AS n FROM incoming_records WHERE key_entry IS NOT NULL GROUP BY ALL)
SELECT i.in_no FROM incoming_records i JOIN first f ON f.db_id = i.db_id AND f.key_entry = i.key_entry
WHERE i.in_no > f.n OR EXISTS (SELECT 1 FROM run_records r WHERE r.db_id = i.db_id AND r.key_entry = i.key_entry)""",
    "p5_sections": f"""WITH keys AS (
  SELECT DISTINCT db_id, key_entry FROM incoming_records WHERE key_entry IS NOT NULL),
{_SECTIONS}
SELECT k.db_id, hex(key_entry) AS key_hex, {_MAYBE}
FROM hashed k LEFT JOIN sections s ON s.db_id = k.db_id GROUP BY k.db_id, key_entry""",
    "p5_section_share": f"""WITH keys AS (
  SELECT db_id, key_entry, count(*) AS n, EXISTS (
    SELECT 1 FROM run_records r WHERE r.db_id = i.db_id AND r.key_entry = i.key_entry) AS old
  FROM incoming_records i WHERE key_entry IS NOT NULL GROUP BY db_id, key_entry),
{_SECTIONS},
said AS (
  SELECT k.db_id, key_entry, n, old, {_MAYBE}
  FROM hashed k LEFT JOIN sections s ON s.db_id = k.db_id GROUP BY k.db_id, key_entry, n, old),
summed AS (
  SELECT sum(n) AS n_asked, count(*) AS n_keys, count(*) FILTER (WHERE NOT old) AS n_new,
    count(*) FILTER (WHERE maybe AND NOT old) AS ws, count(*) FILTER (WHERE NOT maybe AND old) AS wn,
    coalesce(sum(n - 1) FILTER (WHERE NOT maybe), 0) AS later FROM said)
SELECT 'table_sections' AS filter, n_asked::BIGINT AS n_asked, n_keys, n_new, ws AS n_wrong_seen, (wn + later)::BIGINT AS n_wrong_new,
  (ws + wn + later) / n_asked AS wrong_share, (ws + wn) / n_keys AS wrong_share_first FROM summed""",
}
