"""Joins that Spark has no word for, as equality joins with a recheck, or as windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .scan import Running, with_running


def not_covered(required: DataFrame, keys: DataFrame) -> DataFrame:
    """required(ref, paper) without what keys(key) cover: a reference, a paper, or a span of papers, which
    becomes its papers, so both steps are equality anti joins."""
    span = F.when(F.col("key").rlike("^[0-9]+-[0-9]+$"), F.sequence(F.split_part("key", F.lit("-"), F.lit(1)).cast("int"), F.split_part("key", F.lit("-"), F.lit(2)).cast("int")))
    whole = F.when(F.col("key").rlike("^[0-9]+$"), F.array(F.col("key").cast("int")))
    papers = keys.select(F.explode(F.coalesce(span, whole)).alias("paper")).distinct()
    return required.join(papers, "paper", "left_anti").join(keys.select(F.col("key").alias("ref")).distinct(), "ref", "left_anti").select("ref", "paper")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: int) -> DataFrame:
    """Rows with equal keys and |a - b| <= width: the right side is dealt to its bucket and both neighbours."""
    bucket = F.expr(f"{a} div {width}")
    dealt = right.withColumn("__k", F.explode(F.array(*[F.expr(f"{b} div {width}") + d for d in (-1, 0, 1)])))
    return left.withColumn("__k", bucket).join(dealt, [*keys, "__k"]).filter(F.abs(F.col(a) - F.col(b)) <= width).drop("__k")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it (the largest value
    among equals): a running last over both sides, in segments, so that a frequent key isn't one task."""
    both = left.withColumn("__right", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1)).unionByName(right.withColumn("__right", F.col(value)).withColumn("__side", F.lit(0)))
    latest = {f"right_{value}": Running("last", F.col("__right"))}
    return with_running(both, [key], [at, "__side", "__right"], latest).filter("__side = 1").drop("__right", "__side")


def dyadic(low: Column, high: Column) -> Column:
    """The nodes (level, node) that part the whole numbers low to high, two a level at most: node k of a level
    holds the numbers from k * 2**level on, 2**level of them. None if high is below low."""
    node = "struct<level: int, node: bigint>"
    begin = F.struct(low.cast("bigint").alias("a"), (high.cast("bigint") + 1).alias("b"), F.array().cast(f"array<{node}>").alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        live = a < b
        left, right = live & (F.pmod(a, F.lit(2)) == 1), live & (F.pmod(b, F.lit(2)) == 1)
        own = F.array_compact(F.array(F.when(left, F.struct(level.alias("level"), a.alias("node"))), F.when(right & (~left | (b - 1 > a)), F.struct(level.alias("level"), (b - 1).alias("node")))))
        return F.when(~live, acc).otherwise(F.struct(F.shiftright(a + left.cast("bigint"), 1).alias("a"), F.shiftright(b - right.cast("bigint"), 1).alias("b"), F.concat(acc["nodes"], own.cast(f"array<{node}>")).alias("nodes")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), begin, step, lambda acc: acc["nodes"])


def in_spans(points: DataFrame, spans: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Each row of points with each row of spans that holds its point, both ends included: spans of any length are
    twice as many rows as their length has binary digits, and a point looks itself up once for each level that
    a span uses (63 at most, which are one row). A join by equality; a null point, end or start meets nothing."""
    nodes = spans.withColumn("__at", F.explode(dyadic(F.col(low), F.col(high))))
    levels = nodes.agg(F.collect_set("__at.level").alias("__levels"))
    climbed = F.transform("__levels", lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col(point).cast("bigint"), k).alias("node")))
    seen = points.filter(F.col(point).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("__at", F.explode(climbed)).drop("__levels")
    return seen.join(nodes, "__at").drop("__at")


def with_fallback(base: DataFrame, better: DataFrame) -> DataFrame:
    found = base.join(better.select("ref", F.col("text").alias("__t")), "ref", "left")
    return found.select("ref", F.coalesce("__t", "text").alias("text"), F.col("__t").isNull().alias("fallback"))


def best_tier(rows: DataFrame, asked: str, exact: list[str], alias: list[str], inner: str) -> DataFrame:
    """Rows of the best tier: exact, alias, prefix (the first word), substring."""
    low = lambda c: F.lower(F.col(c))
    any_of = lambda cols, test: reduce(lambda a, b: a | b, [test(low(c)) for c in cols])
    tier = F.when(any_of(exact, lambda c: c == asked), 1).when(any_of(alias, lambda c: c == asked), 2).when(any_of(exact, lambda c: c.startswith(asked.split()[0])), 3).when(any_of(exact, lambda c: F.contains(c, F.lit(inner))), 4)
    tiered = rows.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    return tiered.join(F.broadcast(tiered.agg(F.min("tier").alias("tier"))), "tier")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one side alone has, with its side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


