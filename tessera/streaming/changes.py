"""Incremental reads of a mutation log folder with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_changes(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the log's appended rows; each appended file is seen once, and a restart goes on from the checkpoint."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def latest_state(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Last write of each id so far, as a streaming aggregate for update or complete mode; forgotten ids have kind FORGET."""
    last = changes.where("kind in ('INSERT', 'FORGET')").groupBy("id").agg(F.max_by(F.struct("ts", "kind", *columns), "ts").alias("r"))
    return last.select("id", "r.*")


def changes_per_window(changes: DataFrame, event_time: str, window: str, late: str) -> DataFrame:
    """Mutations by kind in tumbling windows of event time; rows later than `late` behind the watermark are dropped."""
    timed = changes.withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window), "kind").agg(F.count(F.lit(1)).alias("n"))
