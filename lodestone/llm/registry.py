"""The corpus operators as named queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_topk, html_extraction, mixing, ngram_jaccard, quality_classifier, quality_rules, secret_scans, sentence_pieces, substring_dedup, url_filters
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shuffle_key")


def op2_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.folded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_exact_topk_search, op3_ngram_jaccard_join, op4_html_extraction, op5_sentence_pieces, op6_quality_rules, op7_substring_dedup, op8_url_filters, op9_quality_classifier, op10_secret_scans)}
ORACLES: dict[str, str] = {"op1_source_mixing": mixing.oracle(), "op2_exact_topk_search": exact_topk.ORACLE, "op3_ngram_jaccard_join": ngram_jaccard.ORACLE, "op7_substring_dedup": substring_dedup.ORACLE}
