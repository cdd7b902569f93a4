"""Problem 1: applying a stream of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: 10^19, one more than the largest signed 64-bit number has digits for.
_SHIFT = "10000000000000000000"


def apply_changes(
    changes: DataFrame,
    keys: Sequence[str],
    seq: str,
    kind: str,
    fields: Sequence[str],
    replace: Sequence[object] = (),
    update: Sequence[object] = (),
    delete: Sequence[object] = (),
    tie: str | None = None,
) -> DataFrame:
    """Current state of a table from its change feed, one row per live key.

    Column-wise last writer wins, in one SQL aggregation: every field takes
    ``max_by`` over the changes that set it, and counts only if that change is
    not older than the key's latest delete or replacement. A *replace* (or
    insert) sets the whole row, so fields it leaves null become null; an
    *update* sets only its non-null fields; a *delete* removes the row, and a
    later update alone brings it back with only the fields it sets.

    Order is ``seq``, and among equal ``seq`` the lowest ``tie`` wins. Seq and
    tie (0 to 2^63-1) are packed into one 38-digit decimal, which Spark
    aggregates in place: with fixed-width fields the whole step is a hash
    aggregation with a map-side partial, so a key that holds a third of all
    changes leaves each task as one row. Arrival order never matters and
    repeats change nothing.

    Ignored: kinds in none of the three lists, null kinds, null or negative
    ``seq``, null or negative ``tie``. Null key parts form a key like any
    other. An empty feed gives an empty state. Columns not asked for are
    neither read nor able to clash; names are quoted.
    """
    if not (replace or update):
        raise ValueError("no kind of change sets anything")
    q = lambda c: "`" + c.replace("`", "``") + "`"
    lit = lambda xs: ", ".join(repr(x) if isinstance(x, str) else str(x) for x in xs)
    among = lambda xs: f"_kind IN ({lit(xs)})" if xs else "false"
    order = f"cast({q(seq)} AS decimal(19,0)) * {_SHIFT}BD"
    if tie:
        order += f" + (9223372036854775807BD - cast({q(tie)} AS decimal(19,0)))"
    order = f"cast({order} AS decimal(38,0))"
    # A delete at the same place in the order as another change is settled by the order itself.
    need = f"{q(seq)} >= 0" + (f" AND {q(tie)} >= 0" if tie else "")
    whole, part, gone = among(replace), among(update), among(delete)
    sets = f"({whole} OR {part})"
    key_list = ", ".join(f"{q(k)} AS _k{i}" for i, k in enumerate(keys))
    field_list = ", ".join(f"{q(f)} AS _f{i}" for i, f in enumerate(fields))
    by = ", ".join(f"_k{i}" for i in range(len(keys)))
    each = "".join(
        f", max_by(_f{i}, _ord) FILTER (WHERE {sets} AND _f{i} IS NOT NULL) AS _v{i}"
        f", max(_ord) FILTER (WHERE {sets} AND _f{i} IS NOT NULL) AS _o{i}"
        for i in range(len(fields))
    )
    out = ", ".join(
        [f"_k{i} AS {q(k)}" for i, k in enumerate(keys)]
        + [f"CASE WHEN _reset IS NULL OR _o{i} >= _reset THEN _v{i} END AS {q(f)}" for i, f in enumerate(fields)]
    )
    return changes.sparkSession.sql(
        f"""
        SELECT {out} FROM (
          SELECT {by},
                 max(_ord) FILTER (WHERE {sets}) AS _set,
                 max(_ord) FILTER (WHERE {gone}) AS _gone,
                 max(_ord) FILTER (WHERE {gone} OR {whole}) AS _reset{each}
          FROM (SELECT {key_list}{", " if field_list else ""}{field_list}, {q(kind)} AS _kind, {order} AS _ord
                FROM {{changes}} WHERE {need})
          WHERE {sets} OR {gone}
          GROUP BY {by})
        WHERE _set IS NOT NULL AND (_gone IS NULL OR _set > _gone)""",
        changes=changes,
    )
