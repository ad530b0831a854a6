"""Link candidates between two corpora by shared rare words, and checks of curated links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stored

RELATIONS = ("restates", "expands", "corrects", "fulfills")


def words_of(rows: DataFrame, key: str, stop: list[str]) -> DataFrame:
    """key, word: the different ASCII words over three letters that are no stop words."""
    split = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z\s]", " "), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    return rows.select(key, F.explode(F.array_distinct(split)).alias("word"))


def propose(queries: DataFrame, targets: DataFrame, q: str, t: str, stop: list[str], least: float, top: int, known: DataFrame | None = None) -> DataFrame:
    """q, t, score: for each query the best targets by the sum of 1/ln(1000 df/N + 2) over shared words,
    the lower target among equals; known pairs are left out after the cut.

    A query's most frequent words, as many as weigh less than `least` together, give no pair by themselves:
    pairs come from its other words, and only those that can still reach `least` are joined with the frequent
    ones. So the words that every text has pair nothing.
    """
    own, other = words_of(queries, q, stop), words_of(targets, t, stop)
    n = targets.agg(F.count("*").alias("total"))
    weight = other.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", (1 / F.ln(F.col("df") / F.col("total") * 1000 + 2)).alias("w"))
    # from the lightest word on; rounding errors must not take a word out of reach
    light = F.sum("w").over(W.partitionBy(q).orderBy("w", "word").rowsBetween(W.unboundedPreceding, 0))
    own = stored(own.join(weight, "word").withColumn("light", light), "query-words")
    few = own.filter(F.col("light") >= least - 1e-9)
    frequent = own.filter(F.col("light") < least - 1e-9)
    reach = frequent.groupBy(q).agg(F.max("light").alias("reach"))
    part = few.join(other, "word").groupBy(q, t).agg(F.sum("w").alias("s"))
    part = part.join(reach, q, "left").filter(F.col("s") + F.coalesce("reach", F.lit(0.0)) >= least - 1e-9).select(q, t, "s")
    part = stored(part, "link-pairs")
    more = part.select(q, t).join(frequent.select(q, "word", "w"), q).join(other, [t, "word"]).select(q, t, F.col("w").alias("s"))
    scores = part.unionByName(more).groupBy(q, t).agg(F.sum("s").alias("score")).filter(F.round("score", 9) >= least)
    rank = F.row_number().over(W.partitionBy(q).orderBy(F.desc(F.round("score", 9)), t))
    best = scores.withColumn("rank", rank).filter(F.col("rank") <= top)
    best = best.join(known, [q, t], "left_anti") if known is not None else best
    return best.select(q, t, F.round("score", 4).alias("score"))


def link_faults(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """links(a, b, relationship): a, b, fault for unknown ends, unknown relations and repeated pairs."""
    again = links.groupBy("a", "b").count().filter("count > 1").select("a", "b", F.lit("repeated pair").alias("fault"))
    odd = links.filter(~F.col("relationship").isin(*RELATIONS) | F.col("relationship").isNull()).select("a", "b", F.lit("unknown relationship").alias("fault"))
    no_a = links.join(left.select(F.col("ref").alias("a")), "a", "left_anti").select("a", "b", F.lit("left end missing").alias("fault"))
    no_b = links.join(right.select(F.col("ref").alias("b")), "b", "left_anti").select("a", "b", F.lit("right end missing").alias("fault"))
    return again.unionByName(odd).unionByName(no_a).unionByName(no_b)
