"""Returns, drawdowns and risk of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import ColumnLike, Series, check_period, div, na_in

DAY_MS = 86_400_000


def returns(s: Series, x: ColumnLike) -> Column:
    d = na_in(x)
    p = s.lag(d)
    return F.when(p != 0, F.try_divide(d, p) - 1).cast("float")


def logreturns(s: Series, x: ColumnLike) -> Column:
    d = na_in(x)
    p = s.lag(d)
    return F.when(p > 0, F.when(d == 0, float("-inf")).otherwise(F.ln(F.when(d > 0, F.try_divide(d, p))))).cast("float")


def cumreturns(s: Series, r: ColumnLike) -> Column:
    d = na_in(r)
    return F.when(d.isNotNull(), F.product(1 + d).over(s.upto) - 1)


def cagr(r: ColumnLike, freq: float = 252) -> Column:
    d = na_in(r)
    return F.pow(F.product(1 + d), F.try_divide(F.lit(float(freq)), F.count(d))) - 1


def dailyreturns(df: DataFrame, by: list[str], ts_ms: str, r: str, tz_minutes: int = 0) -> DataFrame:
    """by, day_ms, ret (float): returns compounded by calendar day, absent days filled with 0."""
    offset = tz_minutes * 60_000
    day = F.floor((F.col(ts_ms) + offset) / DAY_MS).cast("long")
    per_day = df.where(F.col(ts_ms).isNotNull()).groupBy(*by, day.alias("__day")).agg((F.product(1 + na_in(r)) - 1).alias("__r"))
    span = per_day.groupBy(*by).agg(F.min("__day").alias("__a"), F.max("__day").alias("__b"))
    days = span.select(*by, F.explode(F.sequence("__a", "__b")).alias("__day"))
    return days.join(per_day, [*by, "__day"], "left").select(*by, (F.col("__day") * DAY_MS - offset).alias("day_ms"), F.coalesce("__r", F.lit(0.0)).cast("float").alias("ret"))


def dd(s: Series, x: ColumnLike) -> Column:
    """Drawdown: value over the running peak, less 1."""
    d = na_in(x)
    return F.when(d.isNotNull(), div(d, F.max(d).over(s.upto)) - 1)


def with_dd(df: DataFrame, s: Series, x: str) -> DataFrame:
    """df with __dd, __peak and __pos: the common first pass of the drawdown metrics."""
    d = na_in(x)
    return df.withColumn("__x", d).withColumn("__pos", s.pos).withColumn("__peak", F.max(d).over(s.upto)).withColumn("__dd", dd(s, x))


def maxdd(df: DataFrame, s: Series, x: str, name: str = "maxdd") -> DataFrame:
    return with_dd(df, s, x).groupBy(*s.by).agg((-F.min("__dd")).alias(name))


def maxdd_details(df: DataFrame, s: Series, x: str) -> DataFrame:
    """maxdd, peak, trough and end positions: the first trough of the maximum, its peak, and the recovery or last valid row.

    Without a drawdown all positions are the last new high; -1 in an empty series.
    """
    d = with_dd(df, s, x)
    high = F.max("__x").over(s.w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__new", F.col("__x").isNotNull() & (high.isNull() | (F.col("__x") > high)))
    d = d.withColumn("__at", F.last(F.when(F.col("__new"), F.col("__pos")), ignorenulls=True).over(s.upto))
    low = F.min_by(F.struct("__pos", "__at", "__peak"), F.when(F.col("__dd").isNotNull(), F.struct("__dd", "__pos"))).over(s.all)
    d = d.withColumn("__low", low).withColumn("__worst", F.min("__dd").over(s.all))
    later = F.when((F.col("__pos") > F.col("__low.__pos")) & (F.col("__x") > F.col("__low.__peak")), F.col("__pos"))
    last = F.max(F.when(F.col("__x").isNotNull(), F.col("__pos")))
    top = F.max(F.when(F.col("__new"), F.col("__pos")))
    falls = F.min("__worst") < 0
    none = F.lit(-1)
    return d.groupBy(*s.by).agg(
        (-F.min("__dd")).alias("maxdd"),
        F.coalesce(F.when(falls, F.first("__low.__at")).otherwise(top), none).alias("peak"),
        F.coalesce(F.when(falls, F.first("__low.__pos")).otherwise(top), none).alias("trough"),
        F.coalesce(F.when(falls, F.coalesce(F.min(later), last)).otherwise(top), none).alias("end"),
    )


def dduration(df: DataFrame, s: Series, x: str, name: str = "duration") -> DataFrame:
    """Valid rows since the last strict new high, -1 where missing."""
    d = na_in(x)
    before = F.max(d).over(s.w.rowsBetween(Window.unboundedPreceding, -1))
    new = (d.isNotNull() & (before.isNull() | (d > before))).cast("int")
    marked = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(s.upto))
    island = Window.partitionBy(*s.by, "__island").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn(name, F.when(d.isNotNull(), F.count(d).over(island) - 1).otherwise(-1).cast("int"))
    return counted.drop("__new", "__island")


def max_duration(df: DataFrame, s: Series, x: str, name: str = "max_duration") -> DataFrame:
    """The longest duration per key, 0 in a series without drawdown or without values."""
    return dduration(df, s, x, "__d").groupBy(*s.by).agg(F.greatest(F.max("__d"), F.lit(0)).alias(name))


def window_drawdown(s: Series, x: ColumnLike, p: int) -> Column:
    """Struct of the deepest drawdown, the sum of squared drawdowns and the count, in each trailing window with its own peak."""
    v = F.collect_list(na_in(x)).over(s.last(check_period(p)))
    zero = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"), F.lit(0.0).alias("squares"))

    def step(a: Column, e: Column) -> Column:
        peak = F.greatest(a["peak"], e)
        depth = F.when(peak != 0, 1 - F.try_divide(e, peak)).otherwise(0.0)
        return F.struct(peak.alias("peak"), F.greatest(a["worst"], depth).alias("worst"), (a["squares"] + depth * depth).alias("squares"))

    return F.struct(F.aggregate(v, zero, step).alias("a"), F.size(v).alias("n"))


def rollmaxdd(s: Series, x: ColumnLike, p: int) -> Column:
    """Windows are partial at the start."""
    w = window_drawdown(s, x, p)
    return F.when(w["n"] > 0, w["a"]["worst"])


def rollulcer(s: Series, x: ColumnLike, p: int, min_period: int = 1) -> Column:
    w = window_drawdown(s, x, p)
    return F.when(w["n"] >= max(1, min_period), F.sqrt(F.try_divide(w["a"]["squares"], w["n"])))


def ulcer(df: DataFrame, s: Series, x: str, name: str = "ulcer") -> DataFrame:
    return with_dd(df, s, x).groupBy(*s.by).agg(F.sqrt(F.avg(F.col("__dd") * F.col("__dd"))).alias(name))


def growth(first: Column, last: Column, n: Column, freq: float) -> Column:
    """Annual growth from first to last over n periods."""
    return F.when((first > 0) & (n > 0), F.pow(F.try_divide(last, first), F.try_divide(F.lit(float(freq)), n)) - 1)


def recoveryfactor(df: DataFrame, s: Series, x: str, freq: float = 252, name: str = "recoveryfactor") -> DataFrame:
    d = with_dd(df, s, x)
    known = F.when(F.col("__x").isNotNull(), F.col("__pos"))
    first, last = F.min_by("__x", known), F.max_by("__x", known)
    rate = growth(first, last, F.max(known) - F.min(known), freq)
    return d.groupBy(*s.by).agg(F.when(F.min("__dd") != 0, F.try_divide(rate, -F.min("__dd"))).alias(name))


def calmar(df: DataFrame, s: Series, x: str, years: float | None = 3, freq: float = 252, name: str = "calmar") -> DataFrame:
    """Growth over drawdown in the last years * freq periods (None: all)."""
    if years:
        placed = df.withColumn("__at", s.pos)
        last = F.max(F.when(na_in(x).isNotNull(), F.col("__at"))).over(s.all)
        df = placed.withColumn("__last", last).where(F.col("__at") >= F.col("__last") - int(years * freq)).drop("__at", "__last")
    return recoveryfactor(df, s, x, freq, name)


def deviation(r: Column) -> Column:
    sd = F.stddev_samp(r)
    return F.when(sd != 0, sd)


def sharpe(r: ColumnLike, rf: float = 0, freq: float = 252) -> Column:
    e = na_in(r) - rf / freq
    return F.try_divide(F.avg(e) * freq**0.5, deviation(e))


def sortino(r: ColumnLike, required: float = 0, freq: float = 252) -> Column:
    e = na_in(r) - required / freq
    below = F.when(e < 0, e)
    n = F.count(below)
    spread = F.when(n >= 2, F.sqrt(F.try_divide(F.sum(below * below), n - 1)))
    return F.when(spread != 0, F.try_divide(F.avg(e) * freq**0.5, spread))


def rollsharpe(s: Series, r: ColumnLike, p: int, rf: float = 0, freq: float = 252, min_period: int = 1) -> Column:
    e = na_in(r) - rf / freq
    w = s.last(p)
    sd = F.stddev_samp(e).over(w)
    return F.when((F.count(e).over(w) >= min_period) & (sd != 0), F.try_divide(F.avg(e).over(w) * freq**0.5, sd))


def rollsortino(s: Series, r: ColumnLike, p: int, required: float = 0, freq: float = 252, min_period: int = 1) -> Column:
    """The denominator is the sample deviation of the negative returns about their mean."""
    e = na_in(r) - required / freq
    w = s.last(p)
    sd = F.stddev_samp(F.when(e < 0, e)).over(w)
    return F.when((F.count(e).over(w) >= min_period) & (sd != 0), F.try_divide(F.avg(e).over(w) * freq**0.5, sd))


def vol(r: ColumnLike, freq: float = 252) -> Column:
    return deviation(na_in(r)) * freq**0.5


def rollvol(s: Series, r: ColumnLike, p: int, freq: float = 252, min_period: int = 1) -> Column:
    d = na_in(r)
    w = s.last(p)
    sd = F.stddev_samp(d).over(w)
    return F.when((F.count(d).over(w) >= min_period) & (sd != 0), sd * freq**0.5)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def value_at_risk(r: ColumnLike, alpha: float = 0.05, method: str = "historical") -> Column:
    d = na_in(r)
    if not 0 < alpha < 1:
        return F.max(F.lit(None).cast("double"))
    if method == "historical":
        return F.percentile(d, F.lit(alpha))
    return F.avg(d) + deviation(d) * normal_quantile(alpha)


def expshortfall(df: DataFrame, by: list[str], r: str, alpha: float = 0.05, method: str = "historical", name: str = "expshortfall") -> DataFrame:
    d = na_in(r)
    if method != "historical":
        from statistics import NormalDist

        density = NormalDist().pdf(normal_quantile(alpha))
        return df.groupBy(*by).agg((F.avg(d) - deviation(d) * density / alpha).alias(name))
    # One row a key, joined back: aggregates combine ahead of the shuffle.
    at = df.groupBy(*by).agg(F.percentile(d, F.lit(alpha)).alias("__q"))
    return df.join(at, by).groupBy(*by).agg(F.avg(F.when(d <= F.col("__q"), d)).alias(name))


def tail(df: DataFrame, by: list[str], r: str, alpha: float = 0.05, name: str = "tail") -> DataFrame:
    d = na_in(r)
    q = df.join(df.groupBy(*by).agg(F.percentile(d, F.array(F.lit(alpha), F.lit(1 - alpha))).alias("__q")), by)
    low, high = F.avg(F.when(d <= F.element_at("__q", 1), d)), F.avg(F.when(d >= F.element_at("__q", 2), d))
    return q.groupBy(*by).agg(F.when(low != 0, F.try_divide(high, F.abs(low))).alias(name))


def omega(r: ColumnLike, required: float = 0) -> Column:
    e = na_in(r) - required
    return div(F.sum(F.when(e > 0, e).otherwise(F.when(e.isNotNull(), 0.0))), F.sum(F.when(e < 0, -e).otherwise(F.when(e.isNotNull(), 0.0))))
