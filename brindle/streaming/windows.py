"""Windowed aggregates that run alike on tables and on streams. The reference has no streaming; this is an extra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total of tumbling windows over ts; late sets a watermark for streams."""
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
