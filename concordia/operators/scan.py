"""Running values over a key's rows in order, without one task holding the rows of a key.

A key's rows are cut to segments at quantiles of the order, the same for all keys, and each segment is scanned
by itself: at most a share of a key's rows, however frequent the key is. A segment's total (largest
value, sum, last known value) is one row; the totals of the segments before, at most as many a key as there are
cuts, give what each segment carries in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class Running:
    """A value over the rows up to this one: "max" or "sum" of a column, or the "last" one that isn't null. Without
    `own` this row is left out; with `back` it is over the rows from this one on."""

    kind: str
    value: Column
    own: bool = True
    back: bool = False


def _over(kind: str, value: Column, window) -> Column:
    return {"max": F.max, "sum": F.sum, "last": lambda v: F.last(v, ignorenulls=True)}[kind](value).over(window)


def _joined(kind: str, near: Column, carried: Column) -> Column:
    if kind == "last":
        return F.coalesce(near, carried)
    return F.greatest(near, carried) if kind == "max" else F.when(near.isNotNull() | carried.isNotNull(), F.coalesce(near, F.lit(0)) + F.coalesce(carried, F.lit(0)))


def cuts(rows: DataFrame, order: str, parts: int | None = None) -> list:
    """Quantiles of the order, by one pass over the rows."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted({*(rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], 100 * n)).head()[0] or [])})


def _segment(value: Column, at: list) -> Column:
    """How many cuts are below the value, 0 for null: first by blocks of cuts, then in one block, so that a row is
    compared with twice the root of their number."""
    if not at:
        return F.lit(0)
    size = max(1, round(len(at) ** 0.5))
    blocks = [at[k : k + size] for k in range(0, len(at), size)]
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < value))
    passed = below(F.array(*[F.lit(b[-1]) for b in blocks]))
    own = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), passed)
    return F.when(value.isNull(), 0).when(passed == len(blocks), len(at)).otherwise(passed * size + below(own))


def with_running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], parts: int | None = None) -> DataFrame:
    """rows with a column for each running value, null where there is nothing to run over (as a sum is of no rows).

    order: columns that tell a key's rows apart; segments are cut by the first one, so rows that are equal in it stay
    in one. No keys: all rows are one. Null keys are a key; rows with a null in the first column come first.
    """
    seg = _segment(F.col(order[0]), cuts(rows, order[0], parts))
    rows = rows.withColumns({"__seg": seg, **{f"__v{k}": v.value for k, v in enumerate(values.values())}})
    # backwards is forwards in the order turned round: a span up to the last row would be read anew for each row
    ahead, around = [F.col(c).asc_nulls_first() for c in order], [F.col(c).desc_nulls_last() for c in order]
    within = lambda v: W.partitionBy(*keys, "__seg").orderBy(*(around if v.back else ahead)).rowsBetween(W.unboundedPreceding, 0 if v.own else -1)
    across = lambda v: W.partitionBy(*keys).orderBy(F.desc("__seg") if v.back else F.asc("__seg")).rowsBetween(W.unboundedPreceding, -1)
    near, totals, carried = {}, [], {}
    ordered = F.struct(*order)
    for k, v in enumerate(values.values()):
        own = F.col(f"__v{k}")
        near[f"__n{k}"] = _over(v.kind, own, within(v))
        known = F.when(own.isNotNull(), ordered)
        totals.append(({"max": F.max, "sum": F.sum}[v.kind](own) if v.kind != "last" else (F.min_by if v.back else F.max_by)(own, known)).alias(f"__t{k}"))
        carried[f"__c{k}"] = _over(v.kind, F.col(f"__t{k}"), across(v))
    local = rows.withColumns(near)
    held = rows.groupBy(*keys, "__seg").agg(*totals).withColumns(carried).select(*keys, "__seg", *carried)
    names = [*keys, "__seg"]
    match = [local[c].eqNullSafe(held[c]) for c in names]
    joined = local.join(held, match, "left").drop(*[held[c] for c in names])
    out = joined.withColumns({name: _joined(v.kind, F.col(f"__n{k}"), F.col(f"__c{k}")) for k, (name, v) in enumerate(values.items())})
    return out.drop("__seg", *near, *carried, *(f"__v{k}" for k in range(len(values))))
