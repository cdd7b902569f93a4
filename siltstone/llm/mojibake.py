"""Problem 8: garbled text from wrong character encodings: find it, and restore what nothing was lost of."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.joins import join_small
from siltstone.llm.garble import LOST, SINGLE_BYTE, Chain, chains, garbled_forms, restore
from siltstone.llm.tokens import spread
from siltstone.sources.tables import written

#: ASCII characters that end a word; letters and digits don't.
_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_BREAK_CHARS = re.compile(r"[\x00-\x09\x0b-/:-@\[-`{-\x7f]")
#: The same cut as of ``words_of``, on characters.
_TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Bits of one broadcast filter at most, 64 MB: enough for 33 million units; more units take further filters.
FILTER_BITS_MOST = 1 << 29
#: Bits for each unit, at least; with two positions a unit at most 1.4 % of other forms pass.
FILTER_BITS_EACH = 16
#: Characters of the words whose pieces are made together; unspaced texts have words of any length.
PIECE_CHARS = 20_000
_SEED = 42  # of Spark's xxhash64

WORD, RUN, GRAM, SHORT = "word", "run", "gram", "short"
_PIECES = "word string, unit string, kind string, n_texts bigint, source boolean, target boolean"


@dataclass(frozen=True)
class Evidence:
    """What it takes to call a word garbled."""

    #: The clean word is in at least so many times as many different texts as the garbled form.
    ratio: int = 3
    #: Texts the clean word of a form that proves itself must be in; the ratio plays no part there.
    known: int = 2
    #: Pieces of one unspaced word (Chinese, Japanese) that must be garbled forms.
    grams: int = 3


def words_of(text: bytes) -> list[str]:
    """Distinct words of a text with a character beyond ASCII, cut at ASCII white space and punctuation.

    Works on UTF-8 bytes, in C throughout; no part of a text is skipped.
    """
    return [w.decode("utf-8", "replace") for w in set(text.translate(_BREAKS).split()) if not w.isascii()]


def runs_of(word: str) -> list[str]:
    """The stretches of a word beyond ASCII."""
    return "".join(c if c > "\x7f" else " " for c in word).split(" ")


def is_unspaced(c: str) -> bool:
    """Han characters and kana, of scripts written without spaces."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


def is_clean(unit: str) -> bool:
    """Nothing in it shows that it was misread: no U+FFFD, control or unassigned character."""
    return not any(c == LOST or unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in unit)


def _odd(form: str) -> bool:
    """A run that words don't have: a sign that isn't a letter, or letters of several scripts."""
    scripts = {"CJK" if is_unspaced(c) else unicodedata.name(c, "?").split()[0] for c in form if c.isalpha()}
    return len(scripts) > 1 or any(unicodedata.category(c) not in ("Ll", "Lu", "Mn") for c in form)


def proves_itself(form: str) -> bool:
    """Whether a form that turns back into UTF-8 is no word by its looks: a run, or its letters together, are odd.

    Letters of one script are not enough: Russian words are valid UTF-8 in cp866.
    """
    return any(_odd(r) for r in runs_of(form) if r) or _odd("".join(filter(str.isalpha, form)))


def turns_back(chain: Chain) -> bool:
    """Whether every form of a chain holds the UTF-8 of its original, byte by byte: one-byte readings that lose nothing."""
    return not (chain.lost or chain.dropped) and all(a == "utf-8" and b in SINGLE_BYTE for a, b in chain.steps)


def pieces_of(word: str) -> list[tuple[str, str]]:
    """(piece, kind) of a word: itself, its runs, and of long runs every 2 to 4 characters.

    Scripts without spaces have no words in this sense, and their garbled
    forms neither: there characters and pairs of characters are the words.
    """
    out = {(word, WORD)}
    for r in runs_of(word):
        if not r:
            continue
        if r != word:
            out.add((r, RUN))
        if len(r) >= 4:
            out |= {(r[i : i + n], GRAM) for n in (2, 3, 4) for i in range(len(r) - n + 1)}
            if any(map(is_unspaced, r)):
                out |= {(c, SHORT) for c in r if is_unspaced(c)}
    return list(out)


def is_source(unit: str, kind: str) -> bool:
    """Whether garbled forms are generated of a unit: clean words and runs, of unspaced scripts characters and pairs."""
    if not is_clean(unit):
        return False
    if kind in (WORD, RUN):
        return True
    return len(unit) <= 2 and all(map(is_unspaced, unit))


def is_target(form: str, kind: str) -> bool:
    """Whether a piece of a kind may count as garbled at all."""
    if len(form) < 2:
        return False
    if kind == RUN or kind == WORD and len(form) == 2 and not any(c < "\x80" for c in form):
        return _odd(form)
    return True


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        numbers, words = [], []
        for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = t.as_py()
            if raw and not raw.isascii():
                own = words_of(raw)
                words += own
                numbers += [h] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.string())], ["h", "word"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 3 + [pa.int64()] + [pa.bool_()] * 2
    names = _PIECES.replace(",", "").split()[::2]
    for b in batches:
        words, counts = (c.to_pylist() for c in b.columns)
        at = 0
        while at < len(words):
            end, chars = at, 0
            while end < len(words) and (end == at or chars + len(words[end]) <= PIECE_CHARS):
                chars += len(words[end])
                end += 1
            rows = [
                (w, p, k, n, is_source(p, k), is_target(p, k))
                for w, n in zip(words[at:end], counts[at:end], strict=True)
                for p, k in pieces_of(w)
            ]
            at = end
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of each hash in a filter whose size is a power of two."""
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Which of the filters (a power of two) a hash belongs to."""
    return (hashes ^ (hashes >> np.uint64(32))) & np.uint64(slices - 1)


def _form_rows(every: list[Chain], filter_bits, no_of_slice: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words64 = filter_bits.value
        number = {c: i for i, c in enumerate(every)}
        bits = len(words64) * 64
        for b in batches:
            for lo in range(0, len(b), 5000):
                units, counts = (c.to_pylist() for c in b.slice(lo, 5000).columns)
                rows = []
                for c, own, forms in garbled_forms(units, every):
                    no, whole = number[c], turns_back(c)
                    # Words are cut at ASCII punctuation, so forms that have some can be words only without it.
                    forms = _BREAK_CHARS.sub(" ", "\n".join(forms)).split("\n")
                    hashed = np.fromiter((xxhash.xxh64_intdigest(f, _SEED) for f in forms), np.uint64, len(forms))
                    hit = _slice_of(hashed, slices) == no_of_slice
                    for p in _positions(hashed, bits):
                        hit &= (words64[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                    for x in np.flatnonzero(hit).tolist():
                        i, f = own[x], forms[x]
                        if len(f) > 1 and " " not in f and f != units[i]:
                            rows.append((f, units[i], counts[i], no, whole and proves_itself(f)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["unit", "original", "n_original", "chain", "sure"]
                )

    return run


class Mojibake:
    """Garbled words of a corpus, by the garbled forms of its clean words.

    1. Every text gives its distinct words beyond ASCII; texts are told apart
       by a hash, so copies of one text count once, however many there are.
    2. Words give units (themselves, their runs, pieces of unspaced runs) with
       the number of texts; one aggregation with a map-side partial.
    3. Every distinct clean unit is garbled under every encoding chain. Forms
       that no unit equals are dropped at once by a Bloom filter of the units.
       Its size follows their number, so it never fills up; beyond 64 MB there
       are several filters by the form's hash, each in a pass of its own.
    4. The forms are hash-joined with the units: a form that is a unit itself,
       and in far fewer texts than its original, is garbled. However frequent, a
       form is garbled that holds the UTF-8 of a known clean word without loss
       and has a run that looks like no word: a source that misreads all its
       mail the same way makes such forms as frequent as their originals.
    5. A word is garbled if it is such a form, contains a run that is (and
       that looks like no run of letters), or three pieces that are.

    The table of (text, word) is written once to the shared folder, which cuts
    the lineage. Null, empty and ASCII texts have no words and are no cases.
    Correct but unusual characters are frequent enough as they are, or are no
    form of anything frequent; where originals are not three times as frequent as
    their garbled forms, forms that don't prove themselves (other chains than
    UTF-8 in one-byte encodings) give no evidence and no cases.
    """

    def __init__(self, documents: DataFrame, evidence: Evidence = Evidence()):
        self.spark, self.evidence, self.chains = documents.sparkSession, evidence, chains()
        self.texts = documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("text")
        )
        self._table: DataFrame | None = None
        self._hits: DataFrame | None = None
        self._words: DataFrame | None = None

    def _parts(self) -> int:
        sc = self.spark.sparkContext
        return max(2 * sc.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def table(self) -> DataFrame:
        """(h, word): the distinct words beyond ASCII of every different text."""
        if self._table is None:
            rows = self.texts.where(F.col("text").isNotNull()).select("h", F.col("text").cast("binary").alias("text"))
            self._table = written(spread(rows).mapInArrow(_tokens, "h bigint, word string").distinct(), "mojibake-words")
        return self._table

    def pieces(self) -> DataFrame:
        """(word, unit, kind, n_texts, source, target) of every distinct word."""
        words = self.table().groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"))
        # The work per row is large, so the parts follow the cores rather than the bytes: partitioned by another
        # expression than the aggregation, or Spark would drop this shuffle and merge small parts.
        words = words.repartition(self._parts(), F.xxhash64("word"))
        return words.mapInArrow(_pieces, _PIECES)

    def _forms(self, units: DataFrame, clean: DataFrame) -> DataFrame:
        """Garbled forms of the clean units that are units themselves, but for a few: unit, original, n_original, chain, sure."""
        bits = 1 << max(12, (FILTER_BITS_EACH * max(1, units.count()) - 1).bit_length())
        slices = max(1, bits // FILTER_BITS_MOST)
        rows = clean.repartition(4 * self._parts(), F.xxhash64("unit"))
        out = None
        for k in range(slices):
            one = rows.mapInArrow(
                _form_rows(self.chains, self._filter(units, bits // slices, k, slices), k, slices),
                "unit string, original string, n_original bigint, chain int, sure boolean",
            )
            out = one if out is None else out.unionByName(one)
        return out

    def _filter(self, units: DataFrame, bits: int, k: int, slices: int):
        """The k-th of the Bloom filters of the units, two positions each, broadcast; its bits are gathered 64 at a time."""
        h = F.xxhash64("unit")
        both = F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
        rows = (
            units.where(h.bitwiseXOR(F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(slices - 1)) == k)
            .select(F.explode(both).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("w"))
            .toArrow()
        )
        words64 = np.zeros(bits // 64, np.int64)
        words64[rows.column("at").to_numpy()] = rows.column("w").to_numpy()
        return self.spark.sparkContext.broadcast(words64.view(np.uint64))

    def hits(self) -> DataFrame:
        """(word, unit, kind, original, chain): the garbled pieces of every word, each with its most frequent original."""
        if self._hits is not None:
            return self._hits
        pieces = written(self.pieces(), "mojibake-pieces")
        each = pieces.groupBy("unit", "kind").agg(F.sum("n_texts").alias("n_unit"), F.max("source").alias("source"))
        units = written(each.groupBy("unit").agg(F.max("n_unit").alias("n_unit"), F.max("source").alias("source")), "mojibake-units")
        known = units.select("unit", "n_unit")
        forms = self._forms(known, units.where("source").select("unit", "n_unit"))
        garbled = (
            forms.join(known, "unit")
            .where(
                (F.col("n_original") >= F.col("n_unit") * self.evidence.ratio)
                | (F.col("sure") & (F.col("n_original") >= self.evidence.known))
            )
            .groupBy("unit")
            .agg(F.max(F.struct("n_original", "original", (-F.col("chain")).alias("order"))).alias("best"))
            .select("unit", F.col("best.original").alias("original"), (-F.col("best.order")).alias("chain"))
        )
        found = pieces.where("target").join(garbled, "unit")
        self._hits = written(found.select("word", "unit", "kind", "original", "chain"), "mojibake-hits")
        return self._hits

    def words(self) -> DataFrame:
        """(word, kind, unit, original, chain) of every garbled word, with its best evidence: whole word, run, pieces."""
        if self._words is not None:
            return self._words
        best = F.min(
            F.struct(
                F.when(F.col("kind") == WORD, 0).when(F.col("kind") == RUN, 1).otherwise(2).alias("rank"),
                (-F.length("unit")).alias("size"), "unit", "kind", "original", "chain",
            )
        )
        strong = F.sum(F.when(F.col("kind").isin(WORD, RUN), self.evidence.grams).otherwise(1))
        each = self.hits().groupBy("word").agg(best.alias("b"), strong.alias("weight"))
        strong = each.where(F.col("weight") >= self.evidence.grams)
        self._words = written(strong.select("word", "b.kind", "b.unit", "b.original", "b.chain"), "mojibake-garbled")
        return self._words

    def found(self) -> DataFrame:
        """doc_id of every document with a garbled passage."""
        texts = join_small(self.table(), self.words().select("word"), ["word"], "left_semi").select("h").distinct()
        return join_small(self.texts.select("doc_id", "h"), texts, ["h"], "left_semi").select("doc_id")

    def restored(self) -> DataFrame:
        """(doc_id, restored, n_garbled, n_restored) of every document found: the text with verified originals put in.

        A garbled word is replaced by its original where the chain lost
        nothing: turned back as a whole, or known as a clean word, and garbling
        the original gives the word again. Other words stay as they are. A line
        of which at least half the longer words are garbled was misread as a
        whole: it is turned back as a whole by a chain of its words, if that
        loses nothing and gives the originals of all of them, so that short
        words and names come back as well.
        """
        every = self.chains

        def back(word, kind, unit, original, chain):
            c = every[chain]
            whole = restore(word, c)
            if whole is not None:
                return whole
            return original if kind == WORD and unit == word and not c.dropped and LOST not in word else None

        def replaced(text, changes):
            known = {c["word"]: (c["original"], c["chain"]) for c in changes}
            return "\n".join(restored_line(x, known, every) for x in text.split("\n"))

        # Each garbled word is turned back once, in however many texts it is.
        put = F.udf(back, "string", useArrow=True)("word", "kind", "unit", "original", "chain")
        turned = self.words().select("word", "chain", put.alias("original"))
        # A text's own distinct garbled words: bounded by the length of one text.
        changes = written(
            self.table().join(turned, "word")
            .groupBy("h").agg(F.collect_list(F.struct("word", "original", "chain")).alias("changes")), "mojibake-changes"
        )
        restored_n = F.size(F.filter("changes", lambda c: c["original"].isNotNull()))
        # Texts without garbled words are left behind before any text moves.
        found = join_small(self.texts, changes.select("h"), ["h"], "left_semi")
        return found.join(changes, "h").select(
            "doc_id", F.udf(replaced, "string", useArrow=True)("text", "changes").alias("restored"),
            F.size("changes").alias("n_garbled"), restored_n.alias("n_restored"),
        )


def restored_line(line: str, known: dict, every: list[Chain]) -> str:
    """One line with originals put in; known: original and chain of each garbled word of the text.

    Only whole words are replaced, each by its own original, in one pass.
    """
    if line.isascii():
        return line
    words = words_of(line.encode("utf-8", "replace"))
    own = [w for w in words if w in known]
    if own and 2 * len(own) >= sum(len(w) > 2 for w in words):
        originals = {known[w][0] for w in own if known[w][0] is not None}
        for c in sorted({known[w][1] for w in own}):
            whole = restore(line, every[c])
            if whole is not None and all(o in whole for o in originals):
                return whole
    if not own:
        return line
    return _TOKEN.sub(lambda m: known.get(m[0], (None,))[0] or m[0], line)
