"""Tables, OHLCV bars of event rows, and generated series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(events: DataFrame, unit: str = "hour", by: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Open, high, low, close and volume (rows) per key and unit of time; one shuffle, combined map-side.

    Of rows with one time the least value opens and the greatest closes.
    """
    at = F.date_trunc(unit, F.col(ts))
    return events.groupBy(F.col(by).alias("k"), at.alias("bar")).agg(
        F.min(F.struct(ts, value))[value].alias("o"), F.max(value).alias("h"), F.min(value).alias("l"), F.max(F.struct(ts, value))[value].alias("c"), F.count("*").cast("double").alias("v")
    )


def randuniform(spark: SparkSession, n: int, lo: float = 0, hi: float = 1, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), (lo + F.rand(seed) * (hi - lo)).alias("x"))


def randnormal(spark: SparkSession, n: int, mean: float = 0, sd: float = 1, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), (mean + sd * F.randn(seed)).alias("x"))
