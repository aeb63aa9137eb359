"""Event-time aggregates that run alike over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")]


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = _timed(events, late).groupBy(F.window("ts", size), "event_type").agg(*_measures())
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = _timed(events, late).groupBy(F.window("ts", size, step), "event_type").agg(*_measures())
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(*_measures())
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")
