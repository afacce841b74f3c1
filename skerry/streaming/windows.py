"""Windowed counts for streams and tables alike: an extension, beyond what the dialect asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, time: str, size: str, key: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Rows counted by key in tumbling (or sliding) windows of event time; on a stream, late is how long a window waits."""
    if events.isStreaming and late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(F.window(time, size, slide or size).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Rows counted by key in sessions that end after a gap."""
    if events.isStreaming and late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
