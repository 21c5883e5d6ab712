"""Chunk records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunking import from_json_lines, to_json_lines


def write_chunks(chunks: DataFrame, path: str) -> None:
    to_json_lines(chunks).write.mode("overwrite").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return from_json_lines(spark.read.text(path))
