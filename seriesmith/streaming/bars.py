"""OHLCV bars over a stream of events, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """For append or update mode; a bar closes when the watermark passes its end. Ties as in ``bars``."""
    window = F.window(ts, width)
    # A watermark needs an instant; times without a zone are taken in the session's.
    made = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.col(by).alias("k"), window.alias("__w")).agg(
        F.min(F.struct(ts, value))[value].alias("o"), F.max(value).alias("h"), F.min(value).alias("l"), F.max(F.struct(ts, value))[value].alias("c"), F.count("*").cast("double").alias("v")
    )
    return made.select("k", F.col("__w.start").alias("bar"), "o", "h", "l", "c", "v")
