"""The fact table: paragraphs with their reference, place and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

#: The nested form of one paper's file.
PAPER_SCHEMA = (
    "paper_index INT, paper_title STRING, author STRING, footnotes ARRAY<STRING>, sections ARRAY<STRUCT<section_index: INT, section_ref: STRING, section_title: STRING, "
    "pars: ARRAY<STRUCT<par_ref: STRING, par_pageref: STRING, par_content: STRING>>>>"
)


def read_papers(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Nested papers, one JSON file each, or one line each, which Spark can split; what is no JSON fails the read."""
    read = spark.read.schema(PAPER_SCHEMA).option("mode", "FAILFAST")
    return read.json(folder) if lines else read.option("multiLine", True).json(folder, pathGlobFilter="Doc*.json")


def flatten_papers(papers: DataFrame) -> DataFrame:
    """One row a paragraph in document order (paper, section_pos, par_pos); paragraphs that are empty without markup go."""
    sections = papers.select("paper_index", "paper_title", "author", F.posexplode("sections").alias("section_pos", "s"))
    pars = sections.select("paper_index", "paper_title", "author", "section_pos", F.col("s.section_title").alias("section_title"), F.posexplode("s.pars").alias("par_pos", "p"))
    return pars.select(
        F.col("p.par_ref").alias("ref"), F.col("paper_index").alias("paper"), "section_pos", "par_pos", "paper_title", "author", F.coalesce("section_title", F.lit("Introduction")).alias("section_title"),
        F.col("p.par_pageref").alias("page"), F.col("p.par_content").alias("raw"), T.clean_content(F.col("p.par_content")).alias("clean"),
    ).filter("clean != ''")


def paragraphs(documents: DataFrame, headings: bool = False) -> DataFrame:
    """Paragraphs of documents(doc_id, text, lang, source): a source is a paper, a document a section and
    each line that isn't blank a paragraph, numbered by its line. (paper, section, par) orders the corpus
    and needs no global numbering. With headings, a document's first line that isn't blank is the heading of
    all its paragraphs."""
    heading = [F.regexp_extract("text", r"(?m)^[ \t]*(\S.*)$", 1).alias("heading")] if headings else []
    lines = documents.select(F.expr("cast(substring(source, 4) as int)").alias("paper"), F.col("doc_id").alias("section"), F.col("lang").alias("author"), *heading, F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    par = (F.col("pos") + 1).cast("long")
    return lines.filter(F.trim("text") != "").select(
        F.concat_ws("", F.col("paper").cast("string"), F.lit(":"), F.col("section").cast("string"), F.lit("."), par.cast("string")).alias("ref"), "paper", "section", par.alias("par"), "author", "text", *(["heading"] if headings else [])
    )


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where their scan has fewer parts than these, as a file with one row group has: work
    behind it would run in one task. A table of so few parts is small; with more parts nothing is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: The same in DuckDB, to put in front of a query.
PARAGRAPHS_SQL = """
WITH lines AS (SELECT CAST(substr(source, 4) AS INTEGER) AS paper, doc_id AS section, lang AS author, string_split(text, chr(10)) AS ls FROM documents),
paragraphs AS (
  SELECT paper || ':' || section || '.' || i AS ref, paper, section, i AS par, author, ls[i] AS text
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM lines) WHERE trim(ls[i]) <> ''
)"""


def write_paragraphs(rows: DataFrame, path: str) -> None:
    """The prebuilt fact table, one folder a paper, so that a read of one paper opens its folder alone."""
    rows.repartition("paper", F.pmod(F.xxhash64("section"), F.lit(8))).write.mode("overwrite").partitionBy("paper").parquet(path)


def read_paragraphs(spark: SparkSession, path: str, paper: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if paper is None else rows.filter(F.col("paper") == paper)
