"""Byte-level BPE whose merges run on segment trees, many words at a time.

The leaves of a word's tree are the byte positions; a leaf holds the rank of
the pair that begins there, an inner node the least of its two children, with
the position in the low bits: the root is the leftmost pair of minimum rank. A
merge replaces the token at that position, unlinks its right neighbour and
updates three leaves (the pair itself, the one swallowed, the one before), each
along its path to the root: a logarithmic number of nodes. Words of about one
length are merged side by side, one row of a matrix each, so every step is a
few vector operations over all words that still have a pair to merge.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex

# Fixed value: the pattern that splits text before the merges, and the same for texts of ASCII characters only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t\n\r\f\v]+"
    r"|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)
#: Words kept with their ids in a worker; beyond that it starts afresh.
CACHE_WORDS = 400_000
#: Characters of the words kept, likewise: long runs (base64) are few words but much memory.
CACHE_CHARS = 32_000_000
#: Characters of text that are split and encoded together.
CHUNK_CHARS = 1_000_000
#: Elements of the trees that are merged side by side.
TREE_CELLS = 4_000_000
#: Fewer words than this of one length class are merged one by one.
FEW = 6


def byte_symbols() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves; the other bytes, in
    order, are given the characters from 256 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """An encoder of one vocabulary file (JSON with vocab and merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        self.byte_id = np.zeros(256, np.int32)
        for s, b in symbols.items():
            self.byte_id[b] = vocab[s]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int32)
        #: Rank of pairs that never merge; greater than every rank.
        self.none = len(pairs)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        self.first = np.full((256, 256), self.none, np.int64)
        for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if a in byte_of and b in byte_of:
                self.first[byte_of[a], byte_of[b]] = r
        self._pair = dict(zip(key.tolist(), range(len(pairs)), strict=True))
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative token is no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    # Merging

    def merge_one(self, word: bytes) -> list[int]:
        """The ids of one word, on a tree of its own."""
        n = len(word)
        tokens = [int(self.byte_id[b]) for b in word]
        if n == 1:
            return tokens
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        none, shift = self.none, size.bit_length()
        top = none << shift
        tree = [top] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = (int(self.first[word[i], word[i + 1]]) << shift) | i
        for j in range(size - 1, 0, -1):
            tree[j] = min(tree[2 * j], tree[2 * j + 1])
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), self._pair
        mask = (1 << shift) - 1

        def update(i: int, value: int) -> None:
            j = size + i
            tree[j] = value
            while j > 1:
                j >>= 1
                least = min(tree[2 * j], tree[2 * j + 1])
                if tree[j] == least:
                    break
                tree[j] = least

        while tree[1] < top:
            i, r = tree[1] & mask, tree[1] >> shift
            gone = after[i]
            tokens[i], tokens[gone] = int(self.merged[r]), -1
            after[i] = k = after[gone]
            if gone < size:
                update(gone, top)
            if k < n:
                before[k] = i
                update(i, (pair.get(tokens[i] << 32 | tokens[k], none) << shift) | i)
            else:
                update(i, top)
            if (h := before[i]) >= 0:
                update(h, (pair.get(tokens[h] << 32 | tokens[i], none) << shift) | h)
        return [t for t in tokens if t >= 0]

    def merge_many(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of 2 to size + 1 bytes, one after the other, and how many each word has."""
        w, none = len(words), self.none
        lengths = np.fromiter(map(len, words), np.int64, w)
        inside = np.arange(size + 1) < lengths[:, None]
        raw = np.zeros((w, size + 1), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        # One more column stands for the end of the word: it has no token.
        width = size + 2
        tokens = np.full((w, width), -1, np.int32)
        tokens[:, : size + 1] = np.where(inside, self.byte_id[raw], -1)
        shift = size.bit_length()
        top = none << shift
        tree = np.full((w, 2 * size), top, np.int64)
        ranks = np.where(inside[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], none)
        tree[:, size:] = np.where(ranks < none, ranks << shift | np.arange(size), top)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (w, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (w, width)).copy()
        tree, tok, after, before = tree.ravel(), tokens.ravel(), after.ravel(), before.ravel()
        row = np.arange(w)
        mask, end = (1 << shift) - 1, size + 1
        while True:
            root = tree[row * (2 * size) + 1]
            live = root < top
            if not live.all():
                row, root = row[live], root[live]
            if not len(row):
                break
            base, nodes = row * width, row * (2 * size)
            i, r = root & mask, root >> shift
            at = base + i
            gone = after[at].astype(np.int64)
            k = np.minimum(after[base + gone].astype(np.int64), end)
            h = before[at].astype(np.int64)
            tok[at] = merged = self.merged[r]
            tok[base + gone] = -1
            after[at] = k
            before[base + k] = i
            first = h < 0
            h = np.where(first, i, h)
            own = self.rank(merged, tok[base + k])
            prior = np.where(first, none, self.rank(tok[base + h], merged))
            # A word's first pair has none before it: its own leaf is written last.
            leaf = np.concatenate([np.minimum(gone, size - 1), h, i])
            dead = np.full(len(row), top)
            value = np.concatenate(
                [dead, np.where(prior < none, prior << shift | h, top), np.where(own < none, own << shift | i, top)]
            )
            where = np.concatenate([nodes, nodes, nodes])
            # The last byte of a full row begins no pair and has no leaf.
            skip = np.concatenate([gone >= size, np.zeros(2 * len(row), bool)])
            if skip.any():
                keep = ~skip
                leaf, value, where = leaf[keep], value[keep], where[keep]
            j = leaf + size
            tree[where + j] = value
            while True:
                j = j >> 1
                if not j[0]:
                    break
                p = where + 2 * j
                tree[where + j] = np.minimum(tree[p], tree[p + 1])
        kept = tokens >= 0
        return tokens[kept], kept.sum(axis=1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (none empty), one after the other, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        classes = np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64)
        counts = np.ones(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(lengths == 1)
        parts.append((single, self.byte_id[np.frombuffer(b"".join(words[x] for x in single.tolist()), np.uint8)]))
        for c in np.unique(classes[lengths > 1]).tolist():
            size, own = 1 << c, np.flatnonzero((classes == c) & (lengths > 1))
            step = max(1, TREE_CELLS // (2 * size))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                if len(some) < FEW or step < FEW:
                    each = [self.merge_one(words[x]) for x in some.tolist()]
                    n = np.fromiter(map(len, each), np.int64, len(each))
                    ids = np.fromiter(chain.from_iterable(each), np.int32, int(n.sum()))
                else:
                    ids, n = self.merge_many([words[x] for x in some.tolist()], size)
                counts[some] = n
                parts.append((some, ids))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for some, ids in parts:
            n = counts[some]
            out[np.repeat(ends[some] - n, n) + _within(n)] = ids
        return out, counts

    # Texts

    def _codes(self, words: list[str]) -> np.ndarray:
        """A number for each word under which its ids are kept."""
        fresh = list(set(words).difference(self.cache))
        if fresh:
            if self.cache and (len(self.cache) + len(fresh) > CACHE_WORDS or self.held > CACHE_CHARS):
                self._reset()
                fresh = list(set(words))
            self.held += sum(map(len, fresh))
            ids, counts = self.encode_words([x.encode("utf-8", "replace") for x in fresh])
            n = len(self.cache)
            self.lengths = _room(self.lengths, n + len(fresh))
            self.starts = _room(self.starts, n + len(fresh))
            self.pool = _room(self.pool, self.used + len(ids))
            self.lengths[n : n + len(fresh)] = counts
            self.starts[n : n + len(fresh)] = self.used + np.cumsum(counts) - counts
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.cache.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def counts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Numbers of ids of each text, in arrays for some texts at a time."""
        for words, owner, n in _chunks(texts):
            codes = self._codes(words)
            yield np.bincount(owner, self.lengths[codes], n).astype(np.int64)

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, numbers of ids of each text) for some texts at a time; a text without characters has none."""
        for words, owner, n in _chunks(texts):
            codes = self._codes(words)
            lengths = self.lengths[codes]
            ids = self.pool[np.repeat(self.starts[codes], lengths) + _within(lengths)]
            yield ids, np.bincount(owner, lengths, n).astype(np.int64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


_SPLIT, _SPLIT_ASCII = regex.compile(PATTERN), re.compile(ASCII_PATTERN)


def split(text: str) -> list[str]:
    """The words of a text; joined they give the text."""
    return (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)


def _chunks(texts: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, int]]:
    """Words of some texts at a time, the number of each word's text, and how many texts."""
    words: list[str] = []
    sizes: list[int] = []
    chars = 0
    for t in texts:
        own = split(t)
        words += own
        sizes.append(len(own))
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield words, np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            words, sizes, chars = [], [], 0
    if sizes:
        yield words, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def loaded(path: str) -> Bpe:
    """The encoder of a vocabulary file, loaded once in a Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("_siltstone_kept", types.ModuleType("_siltstone_kept")).__dict__
    if path not in kept:
        kept[path] = Bpe(path)
    return kept[path]


