"""Event counts over a stream: repeated events are dropped within the watermark, then counted per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_id", kind: str = "event_type", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, end, kind, n_events) per window of event time; the same code counts a batch."""
    marked = events.withWatermark(ts, late)
    unique = marked.dropDuplicatesWithinWatermark([key]) if events.isStreaming else marked.dropDuplicates([key])
    counted = unique.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n_events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n_events")
