"""The query of each operator over the whole of its tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontamination, exact_dedup, fill_in_middle, filter_audit, language, lattice_lm, license_scan, pii, pivot_search, quality, simhash, token_counts
from .common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), bpe.model_bytes(spark))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"), pii.train(pii.labelled_table()))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, read_table(spark, sf_dir, "labels")))


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(read_table(spark, sf_dir, "documents"), bpe.model_bytes(spark), learn=True)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(read_table(spark, sf_dir, "documents"), bpe.model_bytes(spark))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents")))


OPERATORS = (
    op1_token_counts, op2_pii, op3_exact_dedup, op4_language_id, op5_quality, op6_lattice_lm, op7_license_scan, op8_simhash, op9_bpe_roundtrip, op10_decontamination, op11_topk_search, op12_filter_audit,
    op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op10_decontamination": decontamination.ORACLE_SQL, "op11_topk_search": pivot_search.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
