"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, mixture. Each stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegauge.llm import decontaminate, line_dedup, mixing, quality, simhash
from pagegauge.llm.common import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of at least eight words go; every document stays."""
    return line_dedup.clean(docs, min_words=8)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, with three-word shingles and two bits."""
    return simhash.keep_first(docs, words=3, max_bits=2)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixture(docs, cycle=3, most=3)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixture_stage),
]
# A trained classifier, SimHash components and alignments are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
