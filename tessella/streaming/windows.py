"""Event-time windows over streams (an extension): counts by window and by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and key. On a stream rows later than ``late`` are dropped; on a table nothing is."""
    s = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return s.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return s.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
