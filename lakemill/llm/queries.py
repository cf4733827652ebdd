"""One query per training-data operator, over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import bpe, decontaminate, fingerprint, html_tree, license_scan, ngram_join, quality, secrets, token_count, toxicity
from lakemill.llm.frames import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of every document that the classifier keeps."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).where("keep").select("doc_id", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, links) of every document with a similar one."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of every document found toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).where("toxic").select("doc_id", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_html": op6_html,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op3_ngram_join": ngram_join.CLASSES_SQL,
    "op7_token_counts": token_count.COUNTS_SQL,
    "op8_fingerprints": fingerprint.signatures_sql(),
    "op9_byte_bpe": bpe.ROUND_TRIP_SQL,
    "op10_decontaminate": decontaminate.SPANS_SQL,
}
