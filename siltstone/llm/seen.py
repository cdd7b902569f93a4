"""Problem 5: has this key been seen before? Scalable Bloom chains, an exact check and the rate of wrong answers."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.expressions import bloom_slots
from siltstone.functions.joins import join_small
from siltstone.operators.runs import bloom_valid
from siltstone.sources.published import Folder
from siltstone.sources.tables import scratch, written

KEY = ["db_id", "key_entry"]


@dataclass(frozen=True)
class ChainOptions:
    """Layer i has ``first_capacity * growth^i`` keys and error rate ``error * (1 - tightening) * tightening^i``.

    The rates of all layers sum to less than ``error``, however long the chain
    grows. A layer is full once it holds ``fill`` of its capacity. By default
    the first layer takes 14 bits a key and each next one a third of a bit
    more, 20 bits with 40 million keys.
    """

    first_capacity: int = 256
    growth: int = 2
    error: float = 0.01
    tightening: float = 0.85
    fill: float = 1.0


class Layer:
    """One Bloom filter; positions are ``h1 + i * h2`` modulo its size."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error, self.count = capacity, error, 0
        self.hashes = max(1, math.ceil(math.log2(1 / error)))
        self.size = max(64, math.ceil(capacity * self.hashes / math.log(2)))
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)

    def _slots(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        at = h1.copy()
        for _ in range(self.hashes):
            yield (at % np.uint64(self.size)).astype(np.int64)
            at += h2

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for s in self._slots(h1, h2):
            np.bitwise_or.at(self.bits, s >> 3, np.left_shift(1, s & 7).astype(np.uint8))
        self.count += len(h1)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for s in self._slots(h1, h2):
            out &= (self.bits[s >> 3] >> (s & 7) & 1).astype(bool)
        return out


class Chain:
    """A scalable Bloom filter: it grows by layers and never forgets; a key once added is always found."""

    def __init__(self, options: ChainOptions):
        self.options, self.layers = options, [self._layer(options, 0)]

    @staticmethod
    def _layer(o: ChainOptions, i: int) -> Layer:
        return Layer(o.first_capacity * o.growth**i, o.error * (1 - o.tightening) * o.tightening**i)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key may have been added."""
        out = np.zeros(len(h1), bool)
        for layer in reversed(self.layers):
            rest = np.flatnonzero(~out)
            if not len(rest):
                break
            out[rest] = layer.has(h1[rest], h2[rest])
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Add keys, opening the next layer whenever the last one reaches its fill threshold."""
        at = 0
        while at < len(h1):
            last = self.layers[-1]
            room = int(last.capacity * self.options.fill) - last.count
            if room <= 0:
                self.layers.append(self._layer(self.options, len(self.layers)))
                continue
            last.add(h1[at : at + room], h2[at : at + room])
            at += room

    def load(self, rows: list[dict]) -> None:
        """Take up saved layers, in order; the first one replaces what a new chain begins with."""
        for r in rows:
            if not r["layer"]:
                self.layers = []
            layer = Layer(r["capacity"], r["error"])
            layer.bits, layer.count = np.frombuffer(r["bits"], np.uint8).copy(), r["n_keys"]
            self.layers.append(layer)

    def bound(self) -> float:
        """Bound of the chance that a new key is called seen: 1 - product over the layers of (1 - error)."""
        return 1 - math.prod(1 - x.error for x in self.layers)


#: Columns of a chain's saved layers.
_STATE = "shard int, layer int, capacity bigint, error double, n_keys bigint, bits binary"
_ANSWER = "db_id bigint, key_entry binary, first_no bigint, n_arrivals bigint, maybe boolean, bound double, n_layers int"
_LAYER, _HISTORY, _ARRIVAL = 0, 1, 2


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _advance(options: ChainOptions):
    """Rows of a shard in the order saved layers, history, arrivals to answers and layers; only one chain is held."""
    to_arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(),
                "string": pa.string()}
    schema = pa.schema([(n, to_arrow[k]) for n, k in (x.split() for x in f"kind string, {_STATE}, {_ANSWER}".split(", "))])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns.get(f.name) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def saved(shard: int, chain: Chain) -> Iterator[pa.RecordBatch]:
        for i, x in enumerate(chain.layers):
            own = {"kind": "layer", "shard": shard, "layer": i, "capacity": x.capacity, "error": x.error, "n_keys": x.count,
                   "bits": x.bits.tobytes()}
            yield rows(1, **{k: pa.array([v], schema.field(k).type) for k, v in own.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chain = None, Chain(options)
        for b in batches:
            shards = b.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    if shard is not None:
                        yield from saved(shard, chain)
                    shard, chain = int(shards[lo]), Chain(options)
                own = b.slice(lo, hi - lo)
                m, n = (int(np.searchsorted(own.column("_side").to_numpy(), s)) for s in (_HISTORY, _ARRIVAL))
                if m:
                    chain.load(own.slice(0, m).select(_names(_STATE)[1:]).to_pylist())
                h1 = own.column("_h1").slice(m).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                # An even step could meet few positions.
                h2 = own.column("_h2").slice(m).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) | np.uint64(1)
                k = n - m
                old = ~chain.has(h1[:k], h2[:k])
                chain.add(h1[:k][old], h2[:k][old])
                if n < len(own):
                    maybe = chain.has(h1[k:], h2[k:])
                    chain.add(h1[k:][~maybe], h2[k:][~maybe])
                    tail, size = own.slice(n), len(maybe)
                    yield rows(
                        size,
                        kind=pa.array(["answer"] * size, pa.string()),
                        **{c: tail.column(c).cast(schema.field(c).type) for c in _names(_ANSWER)[:4]},
                        maybe=pa.array(maybe),
                        bound=pa.array(np.full(size, chain.bound())),
                        n_layers=pa.array(np.full(size, len(chain.layers)), pa.int32()),
                    )
        if shard is not None:
            yield from saved(shard, chain)

    return run


class SeenKeys:
    """The keys of all stores ever seen, as saved scalable Bloom chains in a shared folder.

    Keys are hashed into ``shards``, each with a chain of its own, so a store
    that holds a third of all keys is spread like any other. ``advance`` reads
    the saved layers (14 to 20 bits a key), the new history and the new
    arrivals, and nothing of what was added before; it writes answers and grown
    layers and publishes both as a new version by one rename, so a run that is
    lost and repeated adds nothing twice. A task holds one chain at a time; 256
    shards keep it within 200 MB up to 10^10 keys. The number of shards and
    the options belong to the saved state and never change.
    """

    def __init__(self, spark: SparkSession, path: str, options: ChainOptions = ChainOptions(), shards: int = 256):
        self.spark, self._folder = spark, Folder(spark, path)
        state = self._folder.state()
        self.options = ChainOptions(**state["options"]) if state else options
        self.shards = state.get("shards", shards)

    def layers(self) -> DataFrame:
        """The saved layers: shard, layer, capacity, error, n_keys, bits; empty before the first run."""
        state = self._folder.state()
        if not state:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self._folder.path}/{state['folder']}/kind=layer")

    def advance(self, history: DataFrame | None = None, arrivals: DataFrame | None = None) -> DataFrame:
        """Add keys of the history, then ask and add arriving keys; the answers for the first arrival of every key.

        db_id, key_entry, first_no, n_arrivals (of the key), maybe (called
        seen), bound (of the share of wrong answers there), n_layers.

        Repeats of one key are reduced first, with a map-side partial: a key
        that was added is called seen for certain, so only its first arrival
        asks anything. Rows with a null store or key are left out; the empty
        key is one. Without history every first arrival is new but for false answers.
        """
        own = f"step-{uuid.uuid4().hex}"
        version = self._folder.version()
        empty = self.spark.createDataFrame([], "db_id bigint, key_entry binary, in_no bigint")
        # Three hashes of their own: within a shard the positions of h1 and h2 stay evenly spread.
        shard = F.pmod(F.hash(*KEY), F.lit(self.shards)).alias("_shard")
        h = [F.xxhash64(*KEY).alias("_h1"), F.xxhash64("key_entry", "db_id", F.lit(7)).alias("_h2")]
        old = _keyed(empty if history is None else history).select(shard, *h).distinct()
        new = first_arrivals(empty if arrivals is None else arrivals).select(shard, *h, *_names(_ANSWER)[:4])
        saved = self.layers().withColumnRenamed("shard", "_shard")
        rows = (
            saved.withColumn("_side", F.lit(_LAYER))
            .unionByName(old.withColumn("_side", F.lit(_HISTORY)), allowMissingColumns=True)
            .unionByName(new.withColumn("_side", F.lit(_ARRIVAL)), allowMissingColumns=True)
        )
        parts = min(self.shards, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism))
        (
            rows.repartitionById(parts, F.floor(F.col("_shard") * parts / self.shards).cast("int"))
            .sortWithinPartitions("_shard", "_side", "layer", "first_no")
            .mapInArrow(_advance(self.options), f"kind string, {_STATE}, {_ANSWER}")
            .write.partitionBy("kind").parquet(f"{self._folder.path}/{own}")
        )
        self._folder.publish(version + 1, {"folder": own, "shards": self.shards, "options": asdict(self.options)})
        return self.answers()

    def answers(self) -> DataFrame:
        """The answers of the last run."""
        state = self._folder.state()
        everything = self.spark.read.schema(f"kind string, {_ANSWER}").parquet(f"{self._folder.path}/{state['folder']}")
        return everything.where("kind = 'answer'").drop("kind")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY).where(F.col("key_entry").isNotNull() & F.col("db_id").isNotNull())


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """The lowest in_no of every store and key that arrives, and how often it arrives (n_arrivals)."""
    keys = arrivals.where(F.col("key_entry").isNotNull() & F.col("db_id").isNotNull())
    return keys.groupBy(*KEY).agg(F.min("in_no").alias("first_no"), F.count(F.lit(1)).alias("n_arrivals"))


def in_history(history: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of the asked keys (a written table) that really occur in the history, each once.

    The history is reduced by the keys asked before anything moves: few of
    them are broadcast, beyond that both sides meet in a sort-merge join.
    """
    return join_small(_keyed(history), asked.select(*KEY), KEY, "left_semi").distinct()


def chain_answers(
    history: DataFrame, arrivals: DataFrame, options: ChainOptions = ChainOptions(), path: str | None = None
) -> DataFrame:
    """The answers of a chain that holds nothing but this history (see SeenKeys); its state goes to ``path`` or scratch."""
    spark = history.sparkSession
    return SeenKeys(spark, path or scratch(spark, "seen-keys"), options).advance(history, arrivals)


def seen_before(
    history: DataFrame, arrivals: DataFrame, options: ChainOptions = ChainOptions(), path: str | None = None
) -> DataFrame:
    """in_no of every arrival whose key occurs in the store's history or in an earlier arrival.

    The chain answers for every first arrival. Negative answers are right by
    construction and are not checked; only keys called seen meet the history.
    All arrivals but first ones of new keys are cases. Rows without store, key or in_no are none.
    """
    answers = chain_answers(history, arrivals, options, path)
    positive = answers.where("maybe").select(*KEY, "first_no")
    wrong = positive.join(in_history(history, positive), KEY, "left_anti")
    new = answers.where("NOT maybe").select(*KEY, "first_no").unionByName(wrong).withColumnRenamed("first_no", "in_no")
    asked = arrivals.select("in_no", *KEY).dropna()
    # The number is part of the key, so an often repeated key is spread.
    return asked.join(new, ["in_no", *KEY], "left_anti").select("in_no")


def section_pairs(sections: DataFrame) -> DataFrame:
    """What the stored sections of a store say together: db_id, slot, and the slots set beside it in some table.

    A section's 128 slots are two 64-bit masks. For each set slot the masks of
    all tables are or-ed, at most 128 rows a store after a map-side partial.
    """
    bit = lambda lo: "+".join(
        f"if(substring(hex(mask), {2 * (lo + i) + 2}, 1) = '1', {'%dL' % (1 << i) if i < 63 else '(-9223372036854775807L - 1L)'}, 0L)"
        for i in range(64)
    )
    return (
        sections.where(bloom_valid())
        .select("db_id", F.expr(bit(0)).alias("low"), F.expr(bit(64)).alias("high"))
        .withColumn("slot", F.explode(F.expr("filter(sequence(0, 127), i -> if(i < 64, shiftright(low, i), shiftright(high, i - 64)) & 1 = 1)")))
        .groupBy("db_id", "slot")
        .agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    )


def section_answers(sections: DataFrame, keys: DataFrame) -> DataFrame:
    """``maybe`` for each of the keys by the stored sections of its store; a malformed section may hold any key."""
    open_stores = sections.where(~bloom_valid()).select("db_id").distinct().withColumn("_open", F.lit(True))
    asked = keys.withColumn("_s", bloom_slots("key_entry")).withColumn("slot", F.col("_s")[0]).withColumn("_b", F.col("_s")[1])
    hit = F.expr("if(_b < 64, shiftright(low, _b), shiftright(high, _b - 64)) & 1 = 1")
    return (
        asked.join(section_pairs(sections), ["db_id", "slot"], "left")
        .withColumn("_hit", F.coalesce(hit, F.lit(False)))
        .join(open_stores, "db_id", "left")
        .withColumn("maybe", F.col("_hit") | F.coalesce("_open", F.lit(False)))
        .drop("_s", "_b", "slot", "low", "high", "_hit", "_open")
    )


def _report(name: str, asked: DataFrame, later_denied: Column) -> DataFrame:
    """Shares of wrong answers from maybe, seen (the truth), n_arrivals and bound of every first arrival."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    wrong_seen, denied = count(F.col("maybe") & ~F.col("seen")), count(~F.col("maybe") & F.col("seen"))
    wrong_new = denied + F.sum(later_denied)
    return asked.groupBy(F.lit(name).alias("filter")).agg(
        F.sum("n_arrivals").alias("n_asked"),
        F.count(F.lit(1)).alias("n_keys"),
        count(~F.col("seen")).alias("n_new"),
        wrong_seen.alias("n_wrong_seen"),
        wrong_new.alias("n_wrong_new"),
        ((wrong_seen + wrong_new) / F.sum("n_arrivals")).alias("wrong_share"),
        ((wrong_seen + denied) / F.count(F.lit(1))).alias("wrong_share_first"),
        F.max("bound").alias("bound"),
    )


def _with_truth(history: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked keys (a written table) with ``seen``, checked against the history whatever a filter says."""
    known = in_history(history, asked).withColumn("_old", F.lit(True))
    return asked.join(known, KEY, "left").withColumn("seen", F.coalesce("_old", F.lit(False))).drop("_old")


def section_report(history: DataFrame, arrivals: DataFrame, sections: DataFrame) -> DataFrame:
    """The report of the stored table sections (see wrong_answers)."""
    truth = _with_truth(history, written(first_arrivals(arrivals), "first-arrivals"))
    said = section_answers(sections, truth).withColumn("bound", F.lit(None).cast("double"))
    return _report("table_sections", said, F.when(F.col("maybe"), 0).otherwise(F.col("n_arrivals") - 1))


def wrong_answers(
    history: DataFrame, arrivals: DataFrame, sections: DataFrame, options: ChainOptions = ChainOptions()
) -> DataFrame:
    """Share of wrong answers by filter (chain, table_sections) over all arriving records with a key.

    n_asked (records), n_keys (first arrivals), n_new (first arrivals that are
    not in the history), n_wrong_seen (new but called seen), n_wrong_new (not
    new but called new), wrong_share (of all records), wrong_share_first (of
    first arrivals), bound (promised for the chain).

    The truth is taken from the history for every key, not only for those called seen.
    A later arrival is never new; the chain has the key by then and says so, while the stored
    sections know nothing of arrivals and say of each what they said of the first.
    """
    answers = chain_answers(history, arrivals, options)
    chain = _report("chain", _with_truth(history, answers), F.lit(0))
    return chain.unionByName(section_report(history, arrivals, sections))
