"""Stateless queries over streams: every row-wise operator of a query also runs on readStream."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from tessera.plans.query import Query


def stream_parquet(spark: SparkSession, path: str, schema: Any, files_per_trigger: int | None = None) -> Query:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return Query(r.parquet(path))


def windowed_counts(events: DataFrame, time: str, window: str, key: str, late: str) -> DataFrame:
    """Counts by event-time window and key, with a watermark that bounds the state."""
    return events.withWatermark(time, late).groupBy(S.window(time, window), key).agg(S.count(S.lit(1)).alias("n"))


def run_available(q: Query, path: str, checkpoint: str) -> None:
    """Process what is there and stop; sink: Parquet, exactly once by the checkpoint."""
    q.df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
