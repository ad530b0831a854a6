"""Spelling: the word of the vocabulary that an unknown word most likely stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.language import osa_udf
from ..session import ship, stored


def _dealt(rows: DataFrame) -> DataFrame:
    """rows for a join by shuffle, whatever Spark takes their size for: it counts a word's keys, which are dozens, as
    about one, so a table of words that fits its threshold would go to the driver with all keys."""
    return rows.hint("merge")


def _places(word: Column, more: int = 0) -> Column:
    return F.sequence(F.lit(1), F.length(word) + more)


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def deletions(word: Column) -> Column:
    """Hashes of the word with up to two characters taken out at any places: words within two edits (swaps count as
    one) share one of these."""
    two = lambda i: F.transform(F.slice(_places(word), i + 1, F.length(word)), lambda j: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, F.length(word)))))
    one = F.transform(_places(word), lambda i: F.xxhash64(_without(word, i)))
    return F.concat(F.array(F.xxhash64(word)), one, F.flatten(F.transform(_places(word), two)))


def one_edit(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(word), known(v, n): word, v, n of those one edit apart. A key is a word without a letter and the letter's
    place, or a whole word with place 0, so no key has more words than the alphabet letters, and who meet are one edit
    apart."""
    key = lambda k, at: F.struct(k.alias("k"), at.cast("int").alias("at"))
    whole = F.lit(0)
    w, v = F.col("word"), F.col("v")
    other_letter = F.transform(_places(w), lambda i: key(_without(w, i), i))
    letter_more = F.transform(_places(w, 1), lambda i: key(w, i))
    letter_less = F.transform(_places(w), lambda i: key(_without(w, i), whole))
    swapped = F.transform(_places(w, -1), lambda i: key(F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)), F.substring(w, i + 2, F.length(w))), whole))
    own = known.select("v", "n", F.explode(F.concat(F.array(key(v, whole)), F.transform(_places(v), lambda i: key(_without(v, i), i)))).alias("e")).select("v", "n", "e.*")
    return asked.select("word", F.explode(F.concat(other_letter, letter_more, letter_less, swapped)).alias("e")).select("word", "e.*").join(_dealt(own), ["k", "at"]).select("word", "v", "n")


def longer_forms(asked: DataFrame, known: DataFrame) -> DataFrame:
    """word, v, n: the most frequent longer word that begins as a word of nine letters but for its last letter. Each
    opening has its best word before it is met."""
    openings = known.filter(F.length("v") >= 10).select("v", "n", F.explode(F.transform(F.sequence(F.lit(8), F.length("v") - 2), lambda i: F.substring("v", F.lit(1), i))).alias("k"))
    best = openings.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("less"), "v")).alias("b")).select("k", "b.v", (-F.col("b.less")).alias("n"))
    return asked.filter(F.length("word") >= 9).withColumn("k", F.expr("substring(word, 1, length(word) - 1)")).join(_dealt(best), "k").select("word", "v", "n")


def two_edits(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(word), known(v, n): word, v, n of those that two edits make equal, by equality of their deletions."""
    posted = lambda rows, name: rows.select("*", F.explode(deletions(F.col(name))).alias("k"))
    near = posted(asked.select("word"), "word").join(_dealt(posted(known, "v")), "k").drop("k")
    return near.filter(osa_udf("word", "v") <= 2)


def suggest(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """unknown(word) and vocabulary(word, n): word, suggestion. Words of six letters at least; within two
    edits from eight letters on, else one; a longer form of a word of nine letters comes first; words seen
    once are no suggestions; the nearest wins, then the most frequent, then by letters.

    Candidates meet by equality, so no pair is tried that isn't near; and only words without a nearer suggestion look
    for one two edits apart.
    """
    ship(unknown.sparkSession)
    vocabulary = stored(vocabulary, "vocabulary")  # which is counted once
    asked = stored(unknown.filter(F.length("word") >= 6).select("word").distinct().join(_dealt(vocabulary.select("word")), "word", "left_anti"), "asked")
    known = vocabulary.filter("n >= 2 and length(word) >= 4").select(F.col("word").alias("v"), "n")
    best = lambda rows: rows.groupBy("word").agg(F.min_by("v", F.struct("d", -F.col("n"), "v")).alias("suggestion"))
    first = longer_forms(asked, known).withColumn("d", F.lit(0)).unionByName(one_edit(asked, known).withColumn("d", F.lit(1)))
    first = stored(best(first), "nearest")
    rest = asked.filter(F.length("word") >= 8).join(_dealt(first), "word", "left_anti")
    return first.unionByName(best(two_edits(rest, known.filter(F.length("v") >= 6)).withColumn("d", F.lit(2))))
