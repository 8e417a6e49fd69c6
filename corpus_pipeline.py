"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import small_batches, table, written
from graphloom.llm.byte_bpe import byte_bpe
from graphloom.llm.decontamination import decontaminate
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.near_dedup import near_dedup_filter
from graphloom.llm.quality_rules import quality_filter


def _tuned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    small_batches(spark)
    return docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; null ids and repeated rows go by their texts; without labels the base rule alone decides."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars is that of the new text. A null text comes out empty; a null id loses nothing; rows with one id are one document."""
    return line_dedup(_tuned(spark, docs)).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (five words, 0.8). Rows with one id stay or go together; null ids and texts without words stay."""
    return near_dedup_filter(_tuned(spark, docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Rows with one id stay or go together; null ids and texts without words stay; without items all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, for each row; a null text has no ids."""
    return byte_bpe(_tuned(spark, docs))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("decontamination", benchmark_stage), ("byte-level BPE", token_stage)]

#: SQL can't express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
