"""Incremental chunking of new documents (an extension; the batch operators are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import ChunkOptions, chunk_documents


def chunk_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, options: ChunkOptions = ChunkOptions()) -> StreamingQuery:
    """Chunks every document file that arrives in source, once, into a Parquet table."""

    def batch(df: DataFrame, epoch: int) -> None:
        chunk_documents(df, options).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")  # a repeated epoch overwrites itself

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
