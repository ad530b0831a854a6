"""Recall: which groups a draft is about, which paragraphs these require, and which it left unread."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import refs as R, text as T
from ..session import keep_checkpoints

MIN_REASON = 20
NAMED = 3


@dataclass(frozen=True)
class Group:
    """Patterns (Java, lower-cased text): what a draft calls the group, and what the corpus calls it."""

    id: str
    draft: str
    corpus: str


def triggers(drafts: DataFrame, groups: list[Group], limiting: str) -> DataFrame:
    """drafts(draft_id, title, sentences) to draft_id, id, why: title, named (NAMED sentences and more
    name it) or limiting (a sentence that names it sets a limit). Rows of one draft_id are one draft."""
    # columns of their own, so that each pattern runs once a sentence
    low = drafts.select("draft_id", F.lower("title").alias("title"), F.transform("sentences", F.lower).alias("sentences"))
    low = low.select("draft_id", "title", *[F.filter("sentences", lambda s: s.rlike(g.draft)).alias(f"named{k}") for k, g in enumerate(groups)])  # noqa: B023
    parts, reasons = [], []
    for k, g in enumerate(groups):
        named = F.col(f"named{k}")
        parts += [F.max(F.col("title").rlike(g.draft)).alias(f"title{k}"), F.sum(F.size(named)).alias(f"n{k}"), F.max(F.exists(named, lambda s: s.rlike(limiting))).alias(f"limiting{k}")]
        why = F.when(F.col(f"title{k}"), "title").when(F.col(f"n{k}") >= NAMED, "named").when(F.col(f"limiting{k}"), "limiting")
        reasons.append(F.struct(F.lit(g.id).alias("id"), why.alias("why")))
    # counts and flags of a draft are shuffled, never its sentences
    low = low.groupBy("draft_id").agg(*parts)
    return low.select("draft_id", F.explode(F.array(*reasons)).alias("x")).select("draft_id", "x.*").filter("why is not null")


def required(paragraphs: DataFrame, groups: list[Group], skip: list[int] = ()) -> DataFrame:
    """id, ref, paper of the paragraphs that match each group; one scan for all groups."""
    rows = paragraphs.filter(~F.col("paper").isin(*skip)) if skip else paragraphs
    # nulls go after the explosion: of array_compact Spark infers a filter that runs every pattern twice
    hits = F.array(*[F.when(F.col("low").rlike(g.corpus), g.id) for g in groups])
    return rows.select(F.lower("text").alias("low"), "ref", "paper").select(F.explode(hits).alias("id"), "ref", "paper").filter("id is not null")


def unread(triggered: DataFrame, needed: DataFrame, cited: DataFrame, reviewed: DataFrame) -> DataFrame:
    """draft_id, ref: what is required and neither in cited(draft_id, ref) nor covered by
    reviewed(draft_id, key, reason): a reference, a paper or a span of papers, with a reason of
    MIN_REASON characters at least."""
    due = triggered.select("draft_id", "id").join(needed, "id").select("draft_id", "ref", "paper").distinct()
    refs, papers = _seen(cited, reviewed)
    return due.join(refs, ["draft_id", "ref"], "left_anti").join(papers, ["draft_id", "paper"], "left_anti").select("draft_id", "ref")


def _seen(cited: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draft_id, ref) that are cited or reviewed, and (draft_id, paper) that are reviewed as a whole."""
    good = reviewed.filter(F.length(F.trim("reason")) >= MIN_REASON)
    ends = F.split("key", "-")
    papers = F.when(F.col("key").rlike("^[0-9]+$"), F.array(F.col("key").cast("int"))).when(F.col("key").rlike("^[0-9]+-[0-9]+$"), F.sequence(ends[0].cast("int"), ends[1].cast("int")))
    refs = cited.select("draft_id", "ref").unionByName(good.select("draft_id", F.col("key").alias("ref"))).distinct()
    return refs, good.select("draft_id", F.explode(papers).alias("paper")).distinct()


def unread_counts(triggered: DataFrame, needed: DataFrame, cited: DataFrame, reviewed: DataFrame) -> DataFrame:
    """draft_id, n, first_ref: how many rows unread() has for a draft, and their least reference.

    No draft meets the paragraphs it requires. These are counted by the groups they match and their paper;
    a draft starts from the counts of its own groups and takes off what it cites or had reviewed. Each
    count goes with the least references of its paper, one more than any draft cites of any paper, so
    one that isn't cited is among them.
    """
    refs, papers = _seen(cited, reviewed)
    key = lambda c: F.array_sort(F.collect_set(c))
    due = triggered.groupBy("draft_id").agg(key("id").alias("about"))
    # used several times each: written once
    keep_checkpoints(needed.sparkSession)
    due, rows = due.checkpoint(), needed.groupBy("ref", "paper").agg(key("id").alias("groups")).checkpoint()
    off = due.join(refs, "draft_id").join(rows.join(refs.select("ref").distinct(), "ref", "left_semi"), "ref").filter(F.arrays_overlap("about", "groups")).join(papers, ["draft_id", "paper"], "left_anti")
    most = off.groupBy("draft_id", "paper").count().agg(F.coalesce(F.max("count"), F.lit(0))).head()[0]

    by = ["groups", "paper"]
    least = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ref"))).filter(F.col("place") <= most + 1).groupBy(*by).agg(F.collect_list("ref").alias("least"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).join(least, by)
    # the groups of a draft and those of a paragraph meet by any they share, once
    kinds = due.select("about").distinct().select("about", F.explode("about").alias("id")).join(rows.select("groups").distinct().select("groups", F.explode("groups").alias("id")), "id").select("about", "groups").distinct()
    of_paper = kinds.join(counts, "groups").groupBy("about", "paper").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, most + 1).alias("least"))
    totals = of_paper.groupBy("about").agg(F.collect_list(F.struct("paper", "n", "least")).alias("all"))

    has = due.join(totals, "about").join(papers.groupBy("draft_id").agg(F.collect_set("paper").alias("papers")), "draft_id", "left").join(off.groupBy("draft_id").agg(F.collect_list("ref").alias("off")), "draft_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    has = has.withColumn("off", none(F.col("off"), "string")).withColumn("left", F.filter("all", lambda x: ~F.array_contains(none(F.col("papers"), "int"), x["paper"])))
    n = F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x["n"]) - F.size("off")
    first = F.array_min(F.array_except(F.flatten(F.transform("left", lambda x: x["least"])), F.col("off")))
    return has.select("draft_id", n.alias("n"), first.alias("first_ref")).filter("n > 0")


def weak_reasons(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.coalesce(F.length(F.trim("reason")), F.lit(0)) < MIN_REASON)


def cited(drafts: DataFrame) -> DataFrame:
    """draft_id, ref of every reference in drafts(draft_id, text)."""
    return drafts.select("draft_id", F.explode(R.cited_refs(F.col("text"))).alias("ref")).distinct()


def excerpt(text: Column, pattern: str, most: int = 220) -> Column:
    """The first sentence with the pattern, else the first one, cut to `most` characters."""
    all_of = T.sentences(text)
    chosen = F.coalesce(F.try_element_at(F.filter(all_of, lambda s: F.lower(s).rlike(pattern)), F.lit(1)), all_of[0])
    return F.when(F.length(chosen) > most, F.concat(F.substring(chosen, 1, most - 3), F.lit("..."))).otherwise(chosen)


def python_groups(groups: list[Group]) -> list[Group]:
    """Groups whose patterns this interpreter reads: word boundaries of either side become \\b."""
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return [Group(g.id, g.draft.replace(edge, r"\b"), g.corpus.replace(edge, r"\b")) for g in groups]


def resolve(term: str, groups: list[Group]) -> list[Group]:
    """A typed name: a group's id, else groups whose draft pattern has it, else whose corpus pattern has it,
    else the name itself as a whole word."""
    import re

    if own := [g for g in groups if g.id == term]:
        return own
    low = term.lower()
    for part in ("draft", "corpus"):
        if hits := [g for g in groups if re.search(getattr(g, part), low)]:
            return hits
    return [Group(f'"{term}"', T.phrase_pattern(low), T.phrase_pattern(low))]
