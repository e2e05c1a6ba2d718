"""The space-time cube over an event stream: tumbling windows with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_cube(events: DataFrame, width: str = "1 day", late: str = "2 days", key: str = "event_type") -> DataFrame:
    """(key, start, n, total, mean) of events (ts, value, key); the same on batch and streaming DataFrames."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select("key", F.col("w.start").alias("start"), "n", "total", "mean")
