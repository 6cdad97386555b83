"""Queries over long series: every row of ``lineitem`` and ``events``, with a key that holds half of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.series import Series
from ..operators import indicators as ta
from ..operators.recur import Spec, with_recurrences
from ..sources.tables import read_table
from . import recursive
from .catalog import shown, shown_sql

PRICES = Series(["k"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x"])
TICKS = Series(["k"], ["pos"])
ORDER = ", ".join(PRICES.order)
#: One in two events is of the hot key.
KEY = "CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE event_type END"
EVENTS = f"s AS (SELECT {KEY} AS k, event_id AS pos, value AS x FROM events)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("k"), *PRICES.order[:-1], F.col("l_extendedprice").alias("x"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.expr(KEY).alias("k"), F.col("event_id").alias("pos"), F.col("value").alias("x"))


def of_prices(make: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: prices(spark, sf_dir).select("k", *PRICES.order, shown(make()).alias("value"))


def of_ticks(spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_recurrences(ticks(spark, sf_dir), TICKS, {"value": spec})
        return made.select("k", "pos", *[shown(F.col(c)).alias(c) for c in spec.outputs("value")])

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "long_sma": of_prices(lambda: ta.sma(PRICES, "x", 20)),
        "long_bbw": of_prices(lambda: ta.bbw(PRICES, "x", 20)),
        "long_zscore": of_prices(lambda: stats.zscore(PRICES, "x")),
        "long_rollquantile": of_prices(lambda: stats.rollquantile(PRICES, "x", 20, 0.9)),
        "long_ema": of_ticks(Spec("ema", ("x",), (20,))),
        "long_rsi": of_ticks(Spec("rsi", ("x",), (14,))),
        "long_macd": of_ticks(Spec("macd", ("x",), (12, 26, 9))),
    }


def oracle_sql() -> dict[str, str]:
    rows = f"OVER (PARTITION BY k ORDER BY {ORDER} ROWS 19 PRECEDING)"
    base = f"s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {ORDER}) AS n FROM (SELECT l_returnflag AS k, {', '.join(PRICES.order[:-1])}, l_extendedprice AS x FROM lineitem))"
    warm = lambda e: f"CASE WHEN n >= 20 THEN {e} END"
    of = lambda e, more="", last="s": f"WITH {base}{more} SELECT k, {ORDER}, {shown_sql(e)} AS value FROM {last}"
    ordered = f", t AS (SELECT *, list_sort(list(x) {rows}) AS q FROM s)"
    recurrences = recursive.oracle_sql(EVENTS, shown_sql)
    return {
        "long_sma": of(warm(f"avg(x) {rows}")),
        "long_bbw": of(warm(f"400 * stddev_pop(x) {rows} / avg(x) {rows}")),
        "long_zscore": of("(x - avg(x) OVER (PARTITION BY k)) / stddev_samp(x) OVER (PARTITION BY k)"),
        "long_rollquantile": of(warm("(q[18] + q[19]) / 2"), ordered, "t"),
        **{f"long_{n}": recurrences[f"ta_{n}"] for n in ("ema", "rsi", "macd")},
    }
