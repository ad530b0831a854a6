"""Ranked search: exact phrase 100, all terms 50, else 10 for each matched term, plus hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def scored(paragraphs: DataFrame, query: str) -> DataFrame:
    """The paragraphs that match, with matched, hits and score.

    Rows are kept by one alternation of all patterns; the counts are taken from those rows alone, so
    no pattern runs twice for the filter and the projection.
    """
    phrase, terms = T.query_terms(query)
    if not terms:
        return paragraphs.limit(0).select("*", F.lit(0).alias("matched"), F.lit(0).alias("hits"), F.lit(0.0).alias("score"))
    patterns = [T.prefix_pattern(t) for t in terms]
    rows = paragraphs.withColumn("__form", T.search_form(F.col("text"))).filter(F.col("__form").rlike("|".join([*patterns, T.phrase_pattern(phrase)])))
    rows = T.with_term_counts(rows, "__form", terms, "__counts")
    matched = F.size(F.filter("__counts", lambda n: n > 0))
    hits = F.aggregate("__counts", F.lit(0), lambda a, n: a + n)
    rows = rows.withColumn("matched", matched).withColumn("hits", hits)
    tier = F.when(F.col("__form").rlike(T.phrase_pattern(phrase)), 100.0).when(F.col("matched") == len(terms), 50.0).otherwise(F.col("matched") * 10.0)
    return rows.withColumn("score", tier + F.least(F.col("hits"), F.lit(49)) / 50.0).drop("__form", "__counts")


def ranked(found: DataFrame, limit: int | None) -> DataFrame:
    """Best score first, then document order."""
    out = found.orderBy(F.desc("score"), "paper", "section", "par")
    return out.limit(limit) if limit else out


def search(paragraphs: DataFrame, query: str, paper: int | None = None, limit: int = 20) -> DataFrame:
    rows = paragraphs if paper is None else paragraphs.filter(F.col("paper") == paper)
    return ranked(scored(rows, query), limit)


def with_context(found: DataFrame, paragraphs: DataFrame, k: int) -> DataFrame:
    """before and after: up to k texts of the same section on each side.

    found(ref, section) is a search's result, so its rows are as few as the search's limit; they come to the
    driver, and the scan for their neighbours reads the sections they name alone.
    """
    rows = found.collect()
    here = found.sparkSession.createDataFrame(rows, found.schema)
    near = paragraphs.filter(F.col("section").isin(sorted({r.section for r in rows})))
    place = Window.partitionBy("section").orderBy("par")
    texts = near.select(
        "ref", F.collect_list("text").over(place.rowsBetween(-k, -1)).alias("before"), F.collect_list("text").over(place.rowsBetween(1, k)).alias("after")
    )
    return texts.join(F.broadcast(here), "ref")


def lookup(refs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """refs(pos, ref): every row with its text, or an error as a value."""
    found = refs.withColumn("ref", F.trim("ref")).join(paragraphs, "ref", "left")
    error = F.when(~F.col("ref").rlike(r"^[0-9]+:[0-9]+\.[0-9]+$"), "Bad reference; use Paper:Section.Paragraph").when(F.col("text").isNull(), "Reference not found")
    return found.select("pos", "ref", "paper", "text", error.alias("error"))


def document_frequency(paragraphs: DataFrame, terms: list[str], phrases: list[str] = ()) -> DataFrame:
    """term, df: how many paragraphs have a word that starts with each term, or each phrase as it stands.
    One scan; terms of plain characters are found by one pass over a text, the rest by one each."""
    terms = [*dict.fromkeys([*terms, *phrases])]
    plain = [t for t in terms if T.is_plain(t) and t not in phrases]
    form = paragraphs.select(T.search_form(F.col("text")).alias("f"))
    hits = []
    if plain:
        # the term found at a word stands for all terms that it starts with
        also = F.create_map(*[x for t in plain for x in (F.lit(t), F.array(*[F.lit(u) for u in plain if t.startswith(u)]))])
        hits.append(F.array_distinct(F.flatten(F.transform(F.array_distinct(T.starting_terms(F.col("f"), plain)), lambda m: also[m]))))
    others = [F.when(F.col("f").rlike(T.phrase_pattern(t) if t in phrases else T.prefix_pattern(t)), t) for t in terms if t not in plain]
    if others:
        hits.append(F.array_compact(F.array(*others)))
    counts = form.select(F.explode(F.concat(*hits)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = paragraphs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return asked.join(counts, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def rounded(score: Column, digits: int = 4) -> Column:
    return F.round(score, digits)
