"""Incremental scoring: new files of cells are pooled and upserted as they come, and a stopped run goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stemwork.sources.tables import upsert, upsert_sink


def score_stream(spark: SparkSession, source: str, schema, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Starts a query over the Parquet files that come to `source`; it ends when it has read all there are."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(upsert_sink(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_so_far(spark: SparkSession, path: str, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key among all batches."""
    return upsert(None, spark.read.parquet(path).drop("batch"), keys, seq)
