"""The additive metrics over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, time: str, flag: str, value: str, *, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(start, by, n, rate, mean) for tumbling or sliding windows, of a stream or a table; rows later than ``late`` are dropped
    by the watermark."""
    frame = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return frame.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "rate", "mean")
