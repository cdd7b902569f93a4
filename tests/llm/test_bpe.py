"""Problem 6: ids against two public libraries."""

import base64
import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import bpe
from siltstone.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens, encode_documents

PATH = f"{TOKENIZERS}/{VOCABULARY}"


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def third():
    with open(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(own, texts):
    out = []
    for flat, counts in own.encode(texts):
        at = 0
        for n in counts.tolist():
            out.append(flat[at : at + n].tolist())
            at += n
    return out


ODD = [
    "", " ", "\n\n  a", "\x1c\x1d x\x1f", "\x85a\xa0 b", "a" * 3000, "=" * 2000, "日本語" * 300, "don't I'll WE'RE",
    "<|endoftext|>", "　 x", "\r\n\r\n", "é", "\U0001f600" * 40, " \t x", "a\x0bb", "\x1c \x1c", "0" * 999, "ab" * 700,
]


def test_odd_texts(own, other, third):
    assert ids(own, ODD) == [other(t) for t in ODD] == [third(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=12))
def test_any_texts(texts):
    third = test_any_texts.third
    assert ids(test_any_texts.own, texts) == [third(t) for t in texts]


@pytest.fixture(autouse=True, scope="module")
def _for_hypothesis(own, third):
    test_any_texts.own, test_any_texts.third = own, third


def test_one_by_one_and_side_by_side_agree(own, third):
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abcABC01 ee") for _ in range(rnd.choice([2, 3, 9, 17, 33, 64]))) for _ in range(300)]
    flat, counts = own.encode_words(words)
    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        assert flat[at : at + n].tolist() == own.merge_one(w)
        at += n


def test_cache_starts_afresh(own, third, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    fresh = bpe.Bpe(PATH)
    texts = [f"word{i} other{i * 7} same" for i in range(200)]
    assert ids(fresh, texts) == [third(t) for t in texts] and len(fresh.cache) <= 100


def test_cache_is_bounded_in_characters(own, third, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 3000)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    fresh = bpe.Bpe(PATH)
    texts = [f"{i}" + "ab" * 500 + f" {i}" for i in range(40)]
    assert ids(fresh, texts) == [third(t) for t in texts] and sum(map(len, fresh.cache)) <= 5000


def test_documents(spark, third):
    rows = [(1, "Hello wörld"), (2, ""), (3, None), (1, "Hello wörld"), (None, "  "), (4, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id bigint, text string, ids int, n_tokens string")
    want = sorted((str(i), third(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in encode_documents(df).collect()) == want
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in count_tokens(df).collect()) == [(i, len(x)) for i, x in want]
    assert encode_documents(df.limit(0)).count() == 0


def test_whole_corpus(spark, data, other):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: other(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in encode_documents(docs).collect()} == want
