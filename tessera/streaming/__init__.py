"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Takes new files of a folder once each, transforms them and replaces their documents at the target.

    A batch that is repeated after a failure replaces what it wrote before.
    """
    from tessera.sources.ingest import replace_documents

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: replace_documents(transform(df), target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
