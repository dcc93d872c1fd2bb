"""Extra beyond the reference (it has no streams): event-time windows over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and value sums per event-time window and type; works on a batch or a stream (with a watermark)."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    w = ts.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("total").cast("double"), 6).alias("total"))
