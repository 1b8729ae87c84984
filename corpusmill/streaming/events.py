"""Event-time windows over event streams: an extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """window_start, event_type, n, total per tumbling window; works on a stream (with a watermark) and on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sliding_counts(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """user_id, session_start, session_end, n per session of a user."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
