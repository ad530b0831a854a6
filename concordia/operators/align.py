"""Alignment of a timed transcript to a text, and its checks. The matching runs for one paper at a time,
which an hour of speech bounds; repair and checks are windows."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import ship

SLOW, FAST = 1.2, 4.5


def surface(text: str) -> list[str]:
    """Tokens in compatibility form, lower case, punctuation deleted and not spaced."""
    out = (re.sub(r"[^\w]|_", "", w) for w in unicodedata.normalize("NFKC", text).lower().split())
    return [w for w in out if w]


@F.pandas_udf(ArrayType(StringType()))
def surface_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: surface(t or ""))


def align_tokens(text: list[str], heard: list[tuple[str, float, float]]) -> list[tuple[float | None, float | None, bool]]:
    """(start, end, exact) for each token. Equal stretches take the heard times; a replaced stretch shares
    the heard span by token length; a token that nothing was heard for has no time."""
    out: list[tuple[float | None, float | None, bool]] = [(None, None, False)] * len(text)
    for kind, a, b, c, d in difflib.SequenceMatcher(None, text, [h[0] for h in heard], autojunk=False).get_opcodes():
        if kind == "equal":
            out[a:b] = [(h[1], h[2], True) for h in heard[c:d]]
        elif kind == "replace":
            at, end, weight = heard[c][1], heard[d - 1][2], sum(map(len, text[a:b]))
            for k in range(a, b):
                until = at + (end - heard[c][1]) * len(text[k]) / weight
                out[k] = (at, until, False)
                at = until
    return out


def align(tokens: DataFrame, heard: DataFrame) -> DataFrame:
    """tokens(paper, i, ref, w) and heard(paper, token, start, end) to paper, i, ref, w, start, end, x."""
    ship(tokens.sparkSession)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("i"), right.sort_values(["start", "end"])
        times = align_tokens(left.w.tolist(), list(zip(right.token, right.start, right.end)))
        return left.assign(start=[t[0] for t in times], end=[t[1] for t in times], x=[t[2] for t in times])

    return tokens.groupBy("paper").cogroup(heard.groupBy("paper")).applyInPandas(run, "paper int, i int, ref string, w string, start double, end double, x boolean")


def alignment_faults(words: DataFrame) -> DataFrame:
    """words(ref, i, start, end): ref, fault for backward or overlapping words and rates out of bounds."""
    before = W.partitionBy("ref").orderBy("i")
    seen = words.withColumn("__end", F.lag("end").over(before)).groupBy("ref").agg(
        F.count_if(F.col("end") < F.col("start")).alias("backward"), F.count_if(F.col("start") < F.col("__end")).alias("overlaps"), (F.count("*") / (F.max("end") - F.min("start"))).alias("rate")
    )
    faults = F.array_compact(F.array(F.when(F.col("backward") > 0, "ends before it starts"), F.when(F.col("overlaps") > 0, "overlaps"), F.when(~F.col("rate").between(SLOW, FAST), "odd rate")))
    return seen.select("ref", F.explode(faults).alias("fault"))
