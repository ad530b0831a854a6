"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordia.llm import bpe, decontamination, exact_dedup, quality, simhash
from concordia.llm.common import materialize, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Learns from labels and the documents at hand. Null texts are
    judged as empty; repeated rows stay or go together; no documents give none, no labels keep all."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays, once; null counts as empty, a null doc_id
    stays only among null ones; no documents give none."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar fingerprints, the document with the smallest doc_id stays (null ids last);
    null and empty texts are near each other; rows that repeat id and text stay together; no documents
    give none."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go as a whole. Null and empty texts stay; repeated rows stay or go
    together; no documents give none, an empty benchmark keeps all."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id), and the digests of the ids and of the text decoded from them, for
    each row. A null or empty text has the end id alone; repeated rows are encoded alike; no documents
    give none."""
    return bpe.encode_checked(docs, bpe.model_bytes(spark))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("sentencepiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: A trained classifier and SimHash can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
