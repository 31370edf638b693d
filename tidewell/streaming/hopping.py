"""Hopping windows and latest states over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping_counts(events: DataFrame, ts: str, by: list[str], value: str, width: str = "2 hours", stride: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts, sums and extremes a window and key; rows later than ``late`` are dropped, state is bounded by it."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    made = rows.groupBy(F.window(ts, width, stride), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return made.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total", "low", "high")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    made = rows.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return made.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")
