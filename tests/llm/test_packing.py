"""Problem 7: every token once, no capacity exceeded, little unused space."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm.packing import BestFit, fill_report, pack
from siltstone.llm.queries import QUERIES


def check(rows, items, capacities):
    """Containers hold at most their capacity, the smallest that does; parts cover every item once."""
    held, caps, parts = Counter(), {}, defaultdict(list)
    for r in rows:
        held[r["container_id"]] += r["n_tokens"]
        caps.setdefault(r["container_id"], r["capacity"])
        assert caps[r["container_id"]] == r["capacity"]
        parts[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
    for c, n in held.items():
        assert caps[c] == min(x for x in capacities if x >= n)
    for doc, n in items.items():
        at = 0
        for start, size in sorted(parts.pop(doc, [])):
            assert start == at
            at += size
        assert at == max(n or 0, 0)
    assert not parts
    return sum(held.values()) / sum(caps.values())


@pytest.mark.parametrize("capacities", [[512], [512, 2048, 8192], [7, 100]])
@pytest.mark.parametrize("block", [64, 10_000])
def test_random_items(spark, capacities, block):
    rng = np.random.default_rng(len(capacities) + block)
    sizes = np.minimum(rng.lognormal(5, 1.2, 900).astype(int), 30_000)
    items = dict(enumerate(sizes.tolist())) | {9001: 0, 9002: None, 9003: capacities[-1], 9004: capacities[-1] * 3, 9005: -4}
    df = spark.createDataFrame(list(items.items()), "doc_id bigint, n_tokens bigint")
    rows = pack(df, capacities, block_items=block).collect()
    used = check(rows, items, capacities)
    assert used > 0.9
    split = {d for d, n in Counter(r["doc_id"] for r in rows).items() if n > 1}
    assert split == {d for d, n in items.items() if (n or 0) > capacities[-1]}


def test_joint_sizes_beat_any_single_one():
    rng = np.random.default_rng(3)
    sizes = np.clip(rng.lognormal(6, 1, 3000).astype(np.int64), 1, 8192)
    unused = lambda caps: BestFit(caps).pack(sizes)[1].sum() / sizes.sum() - 1
    assert unused([512, 2048, 8192]) <= unused([8192]) + 1e-9 and unused([512, 2048, 8192]) < 0.01


def test_repeated_ids_are_each_packed(spark):
    df = spark.createDataFrame([(1, 10)] * 500, "doc_id bigint, n_tokens bigint")
    rows = pack(df, [100], block_items=64).collect()
    assert len(rows) == 500 and {r["capacity"] for r in rows} == {100}
    held = Counter()
    for r in rows:
        held[r["container_id"]] += r["n_tokens"]
    assert max(held.values()) <= 100


def test_empty_and_bad_capacities(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(df, [10]).count() == 0 and fill_report(pack(df, [10])).count() == 0
    for bad in ([], [0], [-1, 5]):
        with pytest.raises(ValueError):
            BestFit(bad)


def test_queries(spark, data):
    from siltstone.llm.tokens import count_tokens

    items = {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert check(QUERIES["p7_pack"](spark, data).collect(), items, [512, 2048, 8192]) > 0.95
    each = defaultdict(list)
    for r in QUERIES["p7_each"](spark, data).collect():
        each[r["capacity"]].append(r)
    for c, rows in each.items():
        assert check(rows, items, [c]) > 0.75
    fill = {(r["packing"], r["pack_kind"]): r for r in QUERIES["p7_fill"](spark, data).collect()}
    total = sum(items.values())
    assert sum(r["n_tokens"] for (p, _), r in fill.items() if p == "joint") == total
    alone = {k: r for (p, k), r in fill.items() if p == "alone"}
    assert len(alone) == 3 and all(r["n_tokens"] == total for r in alone.values())
    assert {r["capacity"]: r["n_containers"] for r in alone.values()} == {c: len({r["container_id"] for r in rows}) for c, rows in each.items()}


@pytest.mark.parametrize("name", ["p7_pack", "p7_each", "p7_fill"])
def test_texts_are_tokenized_once(spark, data, monkeypatch, name):
    from siltstone.llm import queries

    counted = []
    count = queries.count_tokens
    monkeypatch.setattr(queries, "count_tokens", lambda docs: counted.append(1) or count(docs))
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(counted) == 1 and "documents.parquet" not in plan
