"""Problem 5: chains, exact answers and the rate of wrong ones."""

import random

import numpy as np
import pytest
from compare import connect, oracle_rows, rows_of

from siltstone.llm import seen
from siltstone.llm.queries import ORACLE, QUERIES
from siltstone.llm.seen import Chain, ChainOptions, SeenKeys, seen_before, wrong_answers
from siltstone.sources.tables import SCHEMAS


def hashes(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def test_chain_never_forgets_and_keeps_its_bound():
    rng, chain = np.random.default_rng(1), Chain(ChainOptions(first_capacity=256, error=0.02))
    a, b = hashes(rng, 60_000)
    for lo in range(0, len(a), 1000):
        chain.add(a[lo : lo + 1000], b[lo : lo + 1000])
    assert chain.has(a, b).all() and len(chain.layers) > 6
    assert [x.capacity for x in chain.layers[:3]] == [256, 512, 1024]
    assert all(x.count <= x.capacity for x in chain.layers)
    assert all(x.error > y.error for x, y in zip(chain.layers, chain.layers[1:], strict=False))
    wrong = chain.has(*hashes(rng, 100_000)).mean()
    assert 0 < wrong <= chain.bound() <= 0.02


def tables(spark, old, new):
    h = spark.createDataFrame([(d, 1, 0, 0, k, None, 0, 1) for d, k in old], SCHEMAS["run_records"])
    a = spark.createDataFrame([(i, d, k, None, 0, None) for i, d, k in new], SCHEMAS["incoming_records"])
    return h, a


@pytest.mark.parametrize("seed", range(2))
def test_against_a_set(spark, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([None, bytearray(b""), bytearray(b"hot"), *[bytearray(b"k%d" % rnd.randrange(400))] * 6])
    old = [(rnd.choice([1, 1, 2, None]), key()) for _ in range(500)]
    new = [(i, rnd.choice([1, 2, 3]), key()) for i in range(600)]
    rnd.shuffle(new)
    known = {(d, bytes(k)) for d, k in old if k is not None and d is not None}
    want = set()
    for i, d, k in sorted(new, key=lambda r: r[0]):
        if k is not None:
            want |= {i} if (d, bytes(k)) in known else set()
            known.add((d, bytes(k)))
    h, a = tables(spark, old, new)
    # A loose chain that answers wrongly often: the exact check still gives exact answers.
    for options in (ChainOptions(), ChainOptions(first_capacity=8, error=0.9)):
        assert {r["in_no"] for r in seen_before(h, a, options).collect()} == want


def test_empty_sides(spark):
    h, a = tables(spark, [(1, bytearray(b"a"))], [(1, 1, bytearray(b"a"))])
    assert seen_before(h.limit(0), a).count() == 0 and seen_before(h, a.limit(0)).count() == 0
    assert [r["in_no"] for r in seen_before(h, a).collect()] == [1]


def test_wrong_share_is_reported_and_bounded(spark):
    old = [(1, bytearray(b"old%d" % i)) for i in range(4000)]
    new = [(i, 1, bytearray(b"new%d" % i)) for i in range(4000)] + [(5000, 1, bytearray(b"old1"))]
    h, a = tables(spark, old, new)
    sections = spark.createDataFrame([(1, 1, 128, 2, 9, bytearray(128))], SCHEMAS["bloom_sections"])
    rows = {r["filter"]: r for r in wrong_answers(h, a, sections, ChainOptions(first_capacity=64, error=0.2)).collect()}
    c = rows["chain"]
    assert c["n_asked"] == 4001 and c["n_new"] == 4000 and c["n_wrong_new"] == 0
    assert 0 < c["wrong_share"] <= c["bound"] <= 0.2
    assert rows["table_sections"]["n_wrong_new"] == 1  # the empty section denies the old key


def test_every_arrival_is_asked(spark):
    new = [(i, 1, bytearray(b"hot")) for i in range(9)] + [(20 + i, 1, bytearray(b"old")) for i in range(3)] + [(30, 1, None)]
    h, a = tables(spark, [(1, bytearray(b"old"))], new)
    sections = spark.createDataFrame([(1, 1, 128, 2, 9, bytearray(128))], SCHEMAS["bloom_sections"])
    rows = {r["filter"]: r for r in wrong_answers(h, a, sections).collect()}
    c, t = rows["chain"], rows["table_sections"]
    assert (c["n_asked"], c["n_new"], c["n_wrong_seen"], c["n_wrong_new"]) == (12, 1, 0, 0)
    # The empty section denies 8 later arrivals of the new key and all 3 of the old one.
    assert (t["n_asked"], t["n_new"], t["n_wrong_seen"], t["n_wrong_new"], t["wrong_share"]) == (12, 1, 0, 11, 11 / 12)


def test_every_shard_reports_a_bound(spark, tmp_path):
    h, a = tables(spark, [(1, bytearray(b"a%d" % i)) for i in range(3000)], [(i, 1, bytearray(b"b%d" % i)) for i in range(100)])
    rows = SeenKeys(spark, f"file://{tmp_path}/c", ChainOptions(first_capacity=16), shards=8).advance(h, a).collect()
    assert len(rows) == 100 and all(0 < r["bound"] < 0.01 and r["n_layers"] > 1 for r in rows)


def test_saved_chains_grow_from_new_history_alone(spark, tmp_path):
    """Each run sees only what is new, and the answers are those of all keys so far."""
    path, options = f"file://{tmp_path}/c", ChainOptions(first_capacity=16, error=1e-6)
    old = lambda lo, hi: tables(spark, [(1, bytearray(b"k%d" % i)) for i in range(lo, hi)], [])[0]
    ask = lambda *ks: tables(spark, [], [(i, 1, bytearray(b"k%d" % k)) for i, k in enumerate(ks)])[1]
    one = SeenKeys(spark, path, options, shards=4).advance(old(0, 400), ask(3, 900))
    assert sorted((bytes(r["key_entry"]), r["maybe"]) for r in one.collect()) == [(b"k3", True), (b"k900", False)]
    # Another process, later: new history only; 900 arrived before, 3 is of the first history.
    again = SeenKeys(spark, path)
    assert (again.shards, again.options) == (4, options)
    two = again.advance(old(400, 700), ask(3, 450, 900, 901))
    assert {bytes(r["key_entry"]): r["maybe"] for r in two.collect()} == {b"k3": True, b"k450": True, b"k900": True, b"k901": False}
    layers = again.layers().collect()
    assert sum(r["n_keys"] for r in layers) == 702 and {r["shard"] for r in layers} == set(range(4))
    assert max(r["layer"] for r in layers) > 2


def test_run_lost_before_publishing_adds_nothing(spark, tmp_path, monkeypatch):
    h, a = tables(spark, [(1, bytearray(b"a"))], [(1, 1, bytearray(b"b"))])
    chain = SeenKeys(spark, f"file://{tmp_path}/c", shards=2)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(chain._folder, "publish", lost)
        with pytest.raises(KeyboardInterrupt):
            chain.advance(h, a)
    assert [r["maybe"] for r in SeenKeys(spark, f"file://{tmp_path}/c", shards=2).advance(h, a).collect()] == [False]


def test_only_keys_called_seen_are_checked(spark, monkeypatch):
    """The history meets the positive answers, here the two true ones, and no key that the chain denies."""
    asked = []
    check = seen.in_history
    monkeypatch.setattr(seen, "in_history", lambda h, keys: asked.append(keys) or check(h, keys))
    h, a = tables(spark, [(1, bytearray(b"a%d" % i)) for i in range(50)], [(i, 1, bytearray(b"a%d" % k)) for i, k in enumerate((3, 4, 70, 71, 72))])
    assert {r["in_no"] for r in seen_before(h, a, ChainOptions(error=1e-9)).collect()} == {0, 1}
    assert [sorted(bytes(r["key_entry"]) for r in k.collect()) for k in asked] == [[b"a3", b"a4"]]


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == oracle_rows(connect(data), ORACLE[name])
