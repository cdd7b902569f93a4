"""Problem 1: change feeds against a model in plain Python."""

import random

import pytest

from siltstone.operators.changes import apply_changes

SCHEMA = "k string, seq bigint, tie bigint, kind string, a int, b string, ord string"


def model(rows):
    """Apply the changes one by one, oldest first; of equal sequences the lowest tie comes last."""
    state = {}
    for k, seq, tie, kind, a, b, _ in sorted(
        {r for r in rows if r[1] is not None and r[1] >= 0 and r[2] is not None and r[3] in ("i", "u", "d")},
        key=lambda r: (r[1], -r[2]),
    ):
        if kind == "d":
            state.pop(k, None)
        elif kind == "i":
            state[k] = [a, b]
        else:
            old = state.setdefault(k, [None, None])
            state[k] = [old[0] if a is None else a, old[1] if b is None else b]
    return {(k, *v) for k, v in state.items()}


def run(spark, rows, fields=("a", "b")):
    df = spark.createDataFrame(rows, SCHEMA)
    out = apply_changes(df, ["k"], "seq", "kind", fields, replace=["i"], update=["u"], delete=["d"], tie="tie")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_feeds(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for n in range(1200):
        k = rnd.choice(["hot"] * 6 + [f"k{i}" for i in range(30)] + [None, ""])
        rows.append((k, rnd.choice([None, -1, *range(60)]), n, rnd.choice(["i", "u", "u", "d", "x", None]),
                     rnd.choice([None, 1, 2, 3]), rnd.choice([None, "", "x", "y"]), "c"))
    rows += rnd.choices(rows, k=300)  # repeats, in another order
    rnd.shuffle(rows)
    got = {tuple(r) for r in run(spark, rows).collect()}
    assert got == model(rows)


def test_order_of_arrival_does_not_matter(spark):
    rows = [("k", 3, 0, "u", None, "late", ""), ("k", 1, 1, "i", 1, "first", ""), ("k", 2, 2, "u", 7, None, "")]
    for some in (rows, rows[::-1]):
        assert [tuple(r) for r in run(spark, some).collect()] == [("k", 7, "late")]


def test_update_after_delete_has_only_its_own_fields(spark):
    rows = [("k", 1, 0, "i", 1, "x", ""), ("k", 2, 1, "d", None, None, ""), ("k", 3, 2, "u", None, "y", "")]
    assert [tuple(r) for r in run(spark, rows).collect()] == [("k", None, "y")]


def test_largest_sequences_and_ties(spark):
    top = 2**63 - 1
    rows = [("k", top, top, "i", 1, "x", ""), ("k", top, top - 1, "i", 2, "y", ""), ("k", top - 1, 0, "d", 0, "", "")]
    assert [tuple(r) for r in run(spark, rows).collect()] == [("k", 2, "y")]


def test_empty_feed_and_no_fields(spark):
    assert run(spark, []).collect() == []
    assert [tuple(r) for r in run(spark, [("k", 1, 0, "i", 1, "", "")], fields=()).collect()] == [("k",)]


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, 5, "i", 9, "q")], "_ord int, _kind int, kind string, `a b` int, _set string")
    out = apply_changes(df, ["_kind"], "_ord", "kind", ["a b", "_set"], replace=["i"])
    assert out.columns == ["_kind", "a b", "_set"] and [tuple(r) for r in out.collect()] == [(5, 9, "q")]


def test_nothing_sets_anything(spark):
    with pytest.raises(ValueError):
        apply_changes(spark.createDataFrame([], SCHEMA), ["k"], "seq", "kind", ["a"], delete=["d"])


def test_one_shuffle(spark):
    plan = run(spark, [("k", 1, 0, "i", 1, "", "")], fields=("a",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" in plan and "SortAggregate" not in plan
