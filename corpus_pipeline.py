"""A corpus pipeline: stages over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, ngram_jaccard, quality_rules, secret_scans, sentence_pieces
from lodestone.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # the stages' models, hashes and lattices are beyond SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs, keep=tuple(COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect: the one with the least id. Rows without an id stay."""
    groups = ngram_jaccard.join(docs)
    gone = groups.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked and its length counted again."""
    return secret_scans.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, in shuffled order."""
    return mixing.mix(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every copy."""
    return sentence_pieces.encode(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secrets), ("source_mixing", mixture), ("sentence_pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; all but the last are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
