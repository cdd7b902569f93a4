"""Problem 6: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import loaded

#: Where the vocabulary files are; the same folder on every executor.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts of a binary column one by one; null as the empty text, bytes that are no UTF-8 as U+FFFD."""
    for x in column:
        raw = x.as_py()
        yield raw.decode("utf-8", "replace") if raw else ""


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if the scan gives fewer parts than there are; a large table stays as it is scanned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)


def encode_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}"
) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text, without special tokens.

    A map over Arrow batches without a shuffle: partitions are those of the
    scan (unless those are fewer than the cores), batches are cut into pieces of about a million characters, and a
    worker keeps the ids of words it has met (a bounded number). Each distinct
    new word is merged by segment tree. Null and empty texts give an empty
    list; strings of special tokens are ordinary text; repeated rows and ids
    give a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            at = 0
            for ids, counts in bpe.encode(_texts(b.column(1))):
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(counts)), lists], ["doc_id", "ids"])
                at += len(counts)

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}"
) -> DataFrame:
    """(doc_id, n_tokens) of every row, as encode_documents would give them, without the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            counts = list(bpe.counts(_texts(b.column(1))))
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64())], ["doc_id", "n_tokens"])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, n_tokens bigint")
