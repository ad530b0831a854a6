"""Order and time: tiles, record ids, repair and interpolation, spans of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scan import Running, with_running


def numbered(rows: DataFrame, order: str, buckets: int | None = None, ties: list[str] = ()) -> DataFrame:
    """rows with place, 1 and up in ascending order of a number or date, without one task holding all: rows
    are dealt to buckets by quantiles, numbered within these, and moved by the sizes of those before.

    A row's bucket depends on its value and the quantiles alone, so a task that runs again agrees. Equal
    values go by `ties`, which must tell them apart for places to be the same at every run; a frequent value
    is dealt on by the hash of its ties, so that no value is one task.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], 100 * n)).head()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    # a value that is several quantiles is dealt to as many parts
    often = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1} if ties else {}
    salt = F.lit(0)
    for c, k in often.items():
        salt = F.when(F.col(order) == c, F.pmod(F.xxhash64(*ties), F.lit(k)).cast("int") + 1).otherwise(salt)
    # the rest of a bucket is below its upper cut, so it comes first
    parts = rows.withColumn("__b", F.struct(bucket.alias("b"), salt.alias("s")))
    sizes = parts.groupBy("__b").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select("__b", before.alias("__before"))  # a row for each bucket
    within = F.row_number().over(W.partitionBy("__b").orderBy(order, *ties))
    return parts.withColumn("__n", within).join(F.broadcast(moved), "__b").withColumn("place", F.col("__n") + F.col("__before")).drop("__b", "__n", "__before")


def tiles(rows: DataFrame, order: str, days: int, with_places: bool = False) -> DataFrame:
    """Day k has the places in (round((k-1)n/days), round(kn/days)], rounded half up."""
    placed = numbered(rows, order)
    n = rows.agg(F.count("*").alias("__all"))
    bound = lambda k: F.floor(k * F.col("__all") / float(days) + 0.5)
    guess = F.ceil(F.col("place") * days / F.col("__all"))
    # the day by proportion is right or one off
    day = F.when(F.col("place") <= bound(guess - 1), guess - 1).when(F.col("place") > bound(guess), guess + 1).otherwise(guess)
    placed = placed.crossJoin(F.broadcast(n)).withColumn("day", day.cast("long"))
    out = placed.groupBy("day").agg(F.min(order).alias("start_key"), F.max(order).alias("end_key"), F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    return out if with_places else out.drop("first", "last")


def records(rows: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """record: how many rows up to this one open a record."""
    return with_running(rows, keys, order, {"record": Running("sum", opens.cast("int"))})


def monotonic(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Each start at the latest end before it at least, each end at its start at least."""
    rows = with_running(rows, keys, order, {"__pe": Running("max", F.greatest(start, end), own=False)})
    rows = rows.withColumn(start, F.greatest(start, F.coalesce("__pe", F.lit(0.0)), F.lit(0.0)))
    return rows.withColumn(end, F.greatest(end, start)).drop("__pe")


def interpolate(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Null values on the line between the known ones before and after, by position."""
    placed = with_running(rows, keys, order, {"__i": Running("sum", F.lit(1))})
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("__i").alias("i")))
    found = with_running(placed, keys, order, {"__a": Running("last", known), "__b": Running("last", known, back=True)})
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["i"]) / (b["i"] - a["i"])
    return found.withColumn(value, F.coalesce(F.col(value), line, a["v"], b["v"])).drop("__a", "__b", "__i")


def shortest_stretch(tokens: Column, tests: list[Callable[[Column], Column]]) -> Column:
    """The least distance between first and last of a stretch of tokens that passes every test, null if none
    does: a fold over the tokens with the latest place of each."""
    start = F.struct(F.array(*[F.lit(None).cast("int") for _ in tests]).alias("at"), F.lit(None).cast("int").alias("best"), F.lit(1).alias("i"))

    def step(acc, w):
        at = F.array(*[F.when(test(w), acc["i"]).otherwise(acc["at"][k]) for k, test in enumerate(tests)])
        known = F.forall(at, lambda x: x.isNotNull())
        return F.struct(at.alias("at"), F.least(acc["best"], F.when(known, F.array_max(at) - F.array_min(at))).alias("best"), (acc["i"] + 1).alias("i"))

    return F.aggregate(tokens, start, step, lambda acc: acc["best"])


def minimal_span(rows: DataFrame, key: str, tokens: str, asked: list[str], below: int) -> DataFrame:
    """key, span: the shortest stretch with all asked words, if it is below the bound."""
    best = shortest_stretch(F.col(tokens), [lambda w, a=a: w == a for a in asked])
    return rows.select(key, best.cast("long").alias("span")).filter(F.col("span") < below)


def close_by(tokens: Column, one: Callable[[Column], Column], other: Callable[[Column], Column], within: int) -> Column:
    """Whether a token that passes one test stands within so many places of one that passes the other: a fold with
    the last place of each."""
    far = F.lit(-(1 << 30))
    start = F.struct(far.alias("a"), far.alias("b"), F.lit(0).alias("i"), F.lit(False).alias("close"))

    def step(acc, w):
        a, b = F.when(one(w), acc["i"]).otherwise(acc["a"]), F.when(other(w), acc["i"]).otherwise(acc["b"])
        known = (a >= 0) & (b >= 0)
        return F.struct(a.alias("a"), b.alias("b"), (acc["i"] + 1).alias("i"), (acc["close"] | (known & (F.abs(a - b) <= within))).alias("close"))

    return F.aggregate(tokens, start, step, lambda acc: acc["close"])


def streaks(rows: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """score: hits up to this row; streak: those since the last miss."""
    scored = with_running(rows, keys, order, {"score": Running("sum", hit.cast("int"))})
    # the score at the latest miss is the largest one at a miss
    reset = with_running(scored, keys, order, {"__reset": Running("max", F.when(~hit, F.col("score")))})
    return reset.withColumn("streak", F.col("score") - F.coalesce("__reset", F.lit(0))).drop("__reset")


def thinned(times: Column, least: float) -> Column:
    """How many of sorted times are kept: the first, and each that is at least `least` after the last kept one."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))
    keep = lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= least), F.struct(t.cast("double").alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return F.aggregate(times, start, keep, lambda acc: acc["n"])
