"""Chains of links, each row of which has one next row at most: where they end and which rows a start reaches,
in as many rounds as the longest chain's length has binary digits. A round joins by equality and is written out;
the table of the round before is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import put, remove
from .scan import Running, with_running


def chains(links: DataFrame) -> DataFrame:
    """links(id, next), each id once: id, end, steps, loops of each id. The end is the first node without a link of
    its own, steps the links up to it; a chain that comes back to itself has loops true and nulls. A null next is no
    link; repeated rows are one link, and of an id's several next ones the least counts.

    After k rounds a pointer spans 2**k links. What still runs after as many rounds as the number of links has
    digits runs in a loop, or into one.
    """
    spark = links.sparkSession
    links = links.filter("id is not null and next is not null").groupBy("id").agg(F.min("next").alias("end"))
    state, path = put(links.withColumns({"steps": F.lit(1).cast("bigint"), "open": F.lit(True)}), "chain")
    for _ in range(state.count().bit_length() + 1):
        onward = state.select(F.col("id").alias("end"), F.col("end").alias("__end"), F.col("steps").alias("__steps"), F.col("open").alias("__open"))
        # by shuffle: a written table looks small, and a broadcast of it in every round would pass through the driver
        moved = state.filter("open").join(onward.hint("merge"), "end", "left")
        moved = moved.select("id", F.coalesce("__end", "end").alias("end"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.coalesce("__open", F.lit(False)).alias("open"))
        state, new_path = put(state.filter("not open").unionByName(moved), "chain")
        remove(spark, path)
        path = new_path
        if state.filter("open").isEmpty():
            break
    return state.select("id", F.when(~F.col("open"), F.col("end")).alias("end"), F.when(~F.col("open"), F.col("steps")).alias("steps"), F.col("open").alias("loops"))


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """links(id, next), starts(id): id of each node on the chains that begin at the starts, these included, once.

    What is reached within 2**k links gives, by pointers that span 2**k, what is reached within twice as many;
    a round that adds nothing is the last, so loops end.
    """
    spark = links.sparkSession
    links = links.filter("id is not null and next is not null").groupBy("id").agg(F.min("next").alias("next"))
    jumps, jump_path = put(links, "jumps")
    seen, seen_path = put(starts.select("id").distinct(), "reached")
    n = seen.count()
    while True:
        further = seen.join(jumps.hint("merge"), "id").select(F.col("next").alias("id"))
        new, new_path = put(seen.unionByName(further).distinct(), "reached")
        remove(spark, seen_path)
        seen, seen_path, before, n = new, new_path, n, new.count()
        if n == before:
            remove(spark, jump_path)
            return seen
        onward = jumps.select(F.col("id").alias("next"), F.col("next").alias("__next"))
        longer, longer_path = put(jumps.join(onward.hint("merge"), "next").select("id", F.col("__next").alias("next")), "jumps")
        remove(spark, jump_path)
        jumps, jump_path = longer, longer_path


def kept_marks(rows: DataFrame, keys: list[str], at: str, least: int) -> DataFrame:
    """keys, at of the marks that thinning keeps: a key's first, and each that is `least` or more after the last kept
    one. rows(keys, at) with whole numbers; null marks are none, equal ones are one, null keys are a key.

    A mark's next one, were it kept, is the first at `least` after it: one running value over marks and the moments
    looked for, in segments. The kept ones are what a key's first mark reaches by these links, so no task holds
    the marks of a key and the rounds grow with the logarithm of the marks kept.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    marks = rows.filter(F.col(at).isNotNull()).select(*keys, F.col(at).cast("bigint").alias("at")).distinct()
    # a moment comes before a mark at it, which is found looking back from the end
    asked = marks.select(*keys, (F.col("at") + least).alias("at"), F.lit(0).alias("__side"), F.col("at").alias("__from"))
    both = asked.unionByName(marks.select(*keys, "at", F.lit(1).alias("__side"), F.col("at").alias("__from")))
    mark = F.when(F.col("__side") == 1, F.col("at"))
    found = with_running(both, keys, ["at", "__side"], {"__next": Running("last", mark, back=True)}).filter("__side = 0")
    node = lambda c: F.struct(*keys, F.col(c).alias("at"))
    links = found.select(node("__from").alias("id"), F.when(F.col("__next").isNotNull(), node("__next")).alias("next"))
    first = marks.groupBy(*keys).agg(F.min("at").alias("at")).select(node("at").alias("id"))
    return reached(links, first).select(*[F.col(f"id.{k}") for k in keys], F.col("id.at").alias(at))
