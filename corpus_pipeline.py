"""Corpus pipeline: quality, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it again as the next one's docs, so a stage starts from a table and not from a lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import packing, quality, similar, suffixes
from quernstone.llm.common import scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id."""
    return similar.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes and more that an earlier document has."""
    return suffixes.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed token sequences."""
    return packing.packed(docs)


STAGES = [("quality_classifier", quality_classifier), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_strings), ("packing", sequences)]
#: Models, hash fingerprints and best-fit packing can't be written in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
