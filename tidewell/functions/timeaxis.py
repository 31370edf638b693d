"""Seconds, days and ISO strings on one time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def seconds_since(ts: Column, base: str) -> Column:
    """Whole seconds from ``base`` to ``ts``, rounded down; independent of the session's time zone."""
    return F.timestamp_diff("SECOND", F.lit(base).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def parse_seconds(text: Column, base: str, missing: int = -1) -> Column:
    """Seconds of an ISO string after ``base``; ``missing`` where it does not parse."""
    parsed = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]")).cast("timestamp_ntz")
    return F.coalesce(seconds_since(parsed, base), F.lit(missing).cast("long"))


def iso(seconds: Column, base: str, millis: bool = False) -> Column:
    at = F.timestamp_add("SECOND", seconds.cast("int"), F.lit(base).cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_of(seconds: Column) -> Column:
    return F.floor(seconds / DAY)


def second_of_day(seconds: Column) -> Column:
    return F.pmod(seconds, F.lit(DAY))


def spine(spark: SparkSession, seconds: int, step: int = 1, base: str | None = None) -> DataFrame:
    """(time_s[, timestamp_utc]) for 0, step, ... below ``seconds``."""
    out = spark.range(0, seconds, step).withColumnRenamed("id", "time_s")
    return out.withColumn("timestamp_utc", iso(F.col("time_s"), base)) if base else out
