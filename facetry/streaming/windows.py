"""Windowed aggregates of an event stream (event_id, ts, user_id, event_type, value); each works on batches too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if delay and events.isStreaming else timed


def tumbling(events: DataFrame, size: str, delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window."""
    g = _late(events, delay).groupBy(F.window("ts", size).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, delay: str | None = None) -> DataFrame:
    g = _late(events, delay).groupBy(F.window("ts", size, step).alias("w"))
    return g.agg(F.count("*").alias("n"), F.max("value").alias("highest")).select(F.col("w.start").alias("start"), "n", "highest")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """(user_id, start, n): events of a user less than ``gap`` apart."""
    g = _late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row per key; on a stream, keys are held until the watermark passes them."""
    timed = _late(events, delay)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def read_folder(spark, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
