"""A positional inverted index: the corpus' words in order, stored, and searches that read a range of it.

The postings have one row for each occurrence of a word: (token, paper, section, par, pos, nth), range-partitioned by
word and place and sorted by position too, so that a frequent word is spread over many files and a range of words is a
range of files and row groups, which a Parquet filter finds by their statistics. nth counts a word in its paragraph. Positions number words and
marks alike, so two words with nothing but white space between them have positions one apart. The
dictionary has each word's occurrences and paragraphs. A prefix is a range of words, a phrase is met
by its words' positions, and texts are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window, functions as F

from ..functions import text as T
from .search import ranked

PLACE = ["paper", "section", "par"]
#: A word, or a mark: what has a position.
_LEXEME = f"({T.WORD}+|[^A-Za-z0-9_\\s])"
#: Behind every word that starts with a prefix: no word holds it.
_LAST = "\x7f"
#: Letters of text whose words one task sorts.
PART_LETTERS = 8 << 20


@dataclass
class Index:
    postings: DataFrame
    dictionary: DataFrame


def build(paragraphs: DataFrame, folder: str, part_letters: int = PART_LETTERS) -> Index:
    """Write the index of paragraphs(paper, section, par, text): one shuffle of the words, by range, to as many parts
    as the texts' letters ask for, so that what a task sorts doesn't grow with the corpus. Null texts have no words."""
    spark = paragraphs.sparkSession
    lexemes = paragraphs.select(*PLACE, F.posexplode(F.regexp_extract_all(T.search_form(F.col("text")), F.lit(_LEXEME))).alias("pos", "token"))
    letters = paragraphs.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-letters // part_letters))
    rows = lexemes.filter(F.col("token").rlike(f"^{T.WORD}")).select("token", F.struct(*PLACE).alias("place"), "pos").repartitionByRange(parts, "token", "place")
    # within the ranges and in their own sort, so nothing is shuffled; place is one column, as of columns that are
    # constant the optimizer takes one side away, and the ranges would be dealt anew by hash
    nth = F.row_number().over(Window.partitionBy("token", "place").orderBy("pos"))
    rows.withColumn("nth", nth).sortWithinPartitions("token", "place", "pos").select("token", "place.*", "pos", "nth").write.parquet(f"{folder}/postings")
    # by word alone, so a task holds its words and not a row for each paragraph of a word
    words = spark.read.parquet(f"{folder}/postings").groupBy("token").agg(F.count("*").alias("occurrences"), F.count_if(F.col("nth") == 1).alias("paragraphs"))
    words.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{folder}/dictionary")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/dictionary"))


def starts(term: str) -> Column:
    """Rows of words that start with the term, as a range, which Parquet can skip by."""
    if not T.is_plain(term):
        raise ValueError(f"{term!r} isn't a word; search the texts for it")
    return (F.col("token") >= term) & (F.col("token") < term + _LAST)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _in_order(words: list[str]) -> Column:
    """How often the words stand one behind another, from a row's arrays of positions w0, w1 and so on."""
    first = F.filter("w0", lambda p: reduce(lambda a, b: a & b, [F.array_contains(f"w{k}", p + k) for k in range(1, len(words))], F.lit(True)))
    return F.size(first)


def _positions(words: list[str]) -> list[Column]:
    """The positions of each word of a phrase in a paragraph, to be taken over its rows."""
    return [F.array_compact(F.collect_list(F.when(F.col("token") == w, F.col("pos")))).alias(f"w{k}") for k, w in enumerate(words)]


def _by_place(rows: DataFrame) -> GroupedData:
    """Rows by paragraph. They are shuffled before any is aggregated: files are in the order of words, so where they
    are read hardly two rows are of one paragraph, and a task would hold a group for each row of its range."""
    return rows.repartition(*PLACE).groupBy(*PLACE)


def scored(index: Index, query: str, paper: int | None = None) -> DataFrame:
    """ref, paper, section, par, matched, hits, score of every paragraph that a search finds, as by search.scored()."""
    phrase, terms = T.query_terms(query)
    words = phrase.split()
    rows = index.postings if paper is None else index.postings.filter(F.col("paper") == paper)
    if not terms:
        return rows.limit(0).select(_ref(), *PLACE, F.lit(0).alias("matched"), F.lit(0).alias("hits"), F.lit(0.0).alias("score"))
    rows = rows.filter(_any([starts(t) for t in dict.fromkeys([*terms, *words])]))
    counts = [F.count_if(starts(t)).alias(f"c{k}") for k, t in enumerate(terms)]
    found = _by_place(rows).agg(*counts, *_positions(words))
    n = [F.col(f"c{k}") for k in range(len(terms))]
    matched, hits = reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in n]), reduce(lambda a, b: a + b, n).cast("int")
    whole = _in_order(words) > 0
    tier = F.when(whole, 100.0).when(matched == len(terms), 50.0).otherwise(matched * 10.0)
    return found.filter(whole | (hits > 0)).select(_ref(), *PLACE, matched.alias("matched"), hits.alias("hits"), (tier + F.least(hits, F.lit(49)) / 50.0).alias("score"))


def search(index: Index, query: str, paper: int | None = None, limit: int = 20) -> DataFrame:
    """The best paragraphs, in the order of search.search()."""
    return ranked(scored(index, query, paper), limit)


def phrase(index: Index, words: str) -> DataFrame:
    """ref, paper, section, par, n: paragraphs with the phrase and how often it begins there. Only its words are read."""
    asked = T.query_terms(words)[0].split()
    for w in asked:
        starts(w)
    rows = _by_place(index.postings.filter(F.col("token").isin(asked))).agg(*_positions(asked))
    return rows.select(_ref(), *PLACE, _in_order(asked).alias("n")).filter("n > 0")


def document_frequency(index: Index, terms: list[str], whole: bool = False) -> DataFrame:
    """term, df: paragraphs with a word that starts with each term, or with the word itself if `whole`, which the
    dictionary alone tells. A prefix that one word has is told by it too."""
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    if whole:
        own = index.dictionary.filter(F.col("token").isin(terms)).select(F.col("token").alias("term"), F.col("paragraphs").alias("df"))
    else:
        rows = index.postings.filter(_any([starts(t) for t in terms])).filter("nth = 1")
        named = F.array_compact(F.array(*[F.when(starts(t), t) for t in dict.fromkeys(terms)]))
        own = rows.select(F.explode(named).alias("term"), *PLACE).repartition("term", *PLACE).distinct().groupBy("term").agg(F.count("*").alias("df"))
    return asked.join(own, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def _ref() -> Column:
    return F.concat_ws("", F.col("paper").cast("string"), F.lit(":"), F.col("section").cast("string"), F.lit("."), F.col("par").cast("string")).alias("ref")
