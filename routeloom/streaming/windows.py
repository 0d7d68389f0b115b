"""Event-time windows, the same for a batch and for a stream. An extra of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_totals(events: DataFrame, watermark: str | None = "2 hours") -> DataFrame:
    """``hour, event_type, n, total``. On a stream the watermark bounds the state and closes windows."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    per = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """``user_id, start, end, n``: sessions that a gap without events ends."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    per = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
