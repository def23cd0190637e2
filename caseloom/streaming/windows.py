"""Windowed totals over event streams, and the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly_totals(events: DataFrame, late: str | None = None) -> DataFrame:
    """(event_type, start, n, total) per tumbling hour. On a stream, `late` is the delay after
    which a late event is dropped and its hour is closed."""
    if late:
        events = events.withWatermark("ts", late)
    hours = events.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return hours.select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


def session_totals(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, stop, n) per session."""
    if late:
        events = events.withWatermark("ts", late)
    s = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
