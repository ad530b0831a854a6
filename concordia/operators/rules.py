"""Predicates and rule evaluators over rows, with the rules as parameters: claims, usable sentences, candidates
for banks, overlapping links, missed and garbled questions, lookups of articles, study lists, boosts, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from . import timeline as L


def claims(text: Column, subject: str, verb: str, own: str, lead: int = 140) -> Column:
    """Whether a text (lower case) uses own words, or names the subject with the verb in the `lead` characters
    from there. Citations in parentheses and quotations don't count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\((?:[a-z]{2,5}\s*)?[0-9]{1,3}:[^)]*\)", " "), '"[^"]*"', '"…"')
    at = F.regexp_instr(bare, F.lit(subject))
    return bare.rlike(own) | ((at > 0) & F.substring(bare, F.greatest(at, F.lit(1)), F.lit(lead)).rlike(verb))


def usable(sentence: Column, low: int, high: int, odd: str = "[<>|*]") -> Column:
    """A whole sentence within a length that starts with a capital, ends with a stop and has no odd marks."""
    return F.length(sentence).between(low, high) & sentence.rlike("[.!?]$") & sentence.rlike("^[A-Z]") & ~sentence.rlike(odd)


def bank_candidates(sentences: DataFrame, topics: list[tuple[str, str]], negation: str, low: int = 60, high: int = 160, before: int = 30, odd: str = '[0-9"]') -> DataFrame:
    """sentences(..., sentence) with keyword and topic, of those within a length that have a topic's word, no odd
    marks and no negation in the characters before the word. topics: (start of words, topic), the first that fits."""
    form = F.lower("sentence")
    pattern = "|".join(T.prefix_pattern(t) for t, _ in topics)
    rows = sentences.withColumn("keyword", F.regexp_extract(form, f"({pattern})", 1)).filter("keyword != ''").withColumn("__at", F.instr(form, F.col("keyword")))
    ahead = F.substring(form, F.greatest(F.col("__at") - before, F.lit(1)), F.least(F.lit(before), F.col("__at") - 1))
    rows = rows.filter(F.length("sentence").between(low, high) & ~F.col("sentence").rlike(odd) & ~ahead.rlike(negation))
    topic = F.lit(None).cast("string")
    for start, name in reversed(topics):
        topic = F.when(F.col("keyword").startswith(start), name).otherwise(topic)
    return rows.withColumn("topic", topic).drop("__at")


def overlapping(links: DataFrame, low: int, high: int) -> DataFrame:
    """links(lo, hi) whose span overlaps low to high."""
    return links.filter((F.col("lo") <= high) & (F.col("hi") >= low))


def never_used(questions: DataFrame, corpus: DataFrame, keys: list[str], word: str = "[a-z]{4,}") -> DataFrame:
    """keys, never_used: how many different words of each question(text) no text of corpus(text) has."""
    of = lambda df, *own: df.select(*own, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({word})")))).alias("word")).distinct()
    return of(questions, *keys).join(of(corpus), "word", "left_anti").groupBy(*keys).agg(F.count("*").alias("never_used"))


def find_articles(articles: DataFrame, asked: str, slug: str, title: str) -> DataFrame:
    """articles with tier: 1 for the address itself, else 2 for those whose address and title have all words.
    Only the better tier that has rows stays; `unique` says whether it has one row."""
    low = asked.lower().strip()
    hay = F.lower(F.concat(F.replace(F.col(slug), F.lit("-"), F.lit(" ")), F.lit(" "), F.coalesce(F.col(title), F.lit(""))))
    words = F.array(*[F.lit(w) for w in low.split()])
    tier = F.when(F.lower(slug) == low.replace(" ", "-"), 1).when(F.forall(words, lambda w: F.contains(hay, w)), 2)
    rows = articles.withColumn("tier", tier).filter("tier is not null")
    best = rows.agg(F.min("tier").alias("__best"), F.count_if(F.col("tier") == 1).alias("__one"), F.count_if(F.col("tier") == 2).alias("__two"))
    rows = rows.crossJoin(F.broadcast(best)).filter(F.col("tier") == F.col("__best"))  # one row
    return rows.withColumn("unique", F.when(F.col("tier") == 1, F.col("__one")).otherwise(F.col("__two")) == 1).drop("__best", "__one", "__two")


def study_list(changes: DataFrame, keys: list[str], id: str, added: Column, removed: Column) -> DataFrame:
    """keys and the first added id of each key that no change removes."""
    out = changes.filter(added).groupBy(*keys).agg(F.min(id).alias(f"first_{id.removesuffix('_id')}"))
    return out.join(changes.filter(removed).select(*keys).distinct(), keys, "left_anti")


def gated_boosts(hits: DataFrame, group: str, few: int, all_points: float, else_points: float, otherwise: Column) -> DataFrame:
    """hits with boost: all_points for every hit of a group of at most `few`, else else_points where otherwise holds."""
    n = hits.groupBy(group).agg(F.count("*").alias("__n"))
    boost = F.when(F.col("__n") <= few, all_points).when(otherwise, else_points).otherwise(0.0)
    return hits.join(n, group).withColumn("boost", boost).drop("__n")


def place_bonus(rows: DataFrame, group: str, order: list[Column], limit: int, score: Column) -> DataFrame:
    """group, score: the sum over each group's best `limit` rows of score and (limit - place) / (4 * limit)."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    best = rows.withColumn("__i", place).filter(F.col("__i") < limit)
    return best.groupBy(group).agg(F.sum((limit - F.col("__i")) / float(4 * limit) + score).alias("score"))


def of_the_day(days: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """days(day) with the item whose place is the day's number since the epoch modulo the number of items."""
    placed = L.numbered(items.select(item), item).withColumn("__k", F.col("place") - 1).drop("place")
    n = items.agg(F.count("*").alias("__n"))
    keyed = days.crossJoin(F.broadcast(n)).withColumn("__k", F.pmod(F.unix_date("day").cast("long"), F.col("__n")))  # one row
    return keyed.join(placed, "__k").select("day", item)


def newest_version(rows: DataFrame, group: str, tag: str, pattern: str = r"v([0-9]+)\.([0-9]+)\.([0-9]+)$") -> DataFrame:
    """group, newest: the tag whose three numbers are the largest, as numbers."""
    part = lambda k: F.regexp_extract(tag, pattern, k).cast("long")
    return rows.groupBy(group).agg(F.max_by(tag, F.struct(part(1), part(2), part(3))).alias("newest"))


def progress(rows: DataFrame, group: str, item: str, done: Column) -> DataFrame:
    """group, pct: how much of each group's items is done, rounded; next_item: the first that isn't."""
    return rows.groupBy(group).agg(F.round(100 * F.count_if(done) / F.count("*")).cast("int").alias("pct"), F.min(F.when(~done, F.col(item))).alias("next_item"))


def names_without_plain_use(texts: DataFrame, key: str, most: int, least_letters: int = 4) -> DataFrame:
    """name, n: capitalised words of at most `most` texts that never come in lower case."""
    edge = lambda body: F.lit(f"(?<!{T.WORD})({body})(?!{T.WORD})")
    names = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", edge(f"[A-Z][a-z]{{{least_letters - 1},}}")))).alias("name"))
    low = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", edge(f"[a-z]{{{least_letters},}}")))).alias("word")).distinct()
    n = names.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return n.join(low, F.lower("name") == F.col("word"), "left_anti")
