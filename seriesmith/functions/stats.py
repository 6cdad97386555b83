"""Descriptive statistics: aggregates, whole-series transforms, rolling statistics, sampling."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arr import align
from .math import clamp, if_dense
from .series import ColumnLike, Series, na_in, paired


def check_q(q: float) -> float:
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    return float(q)


def check_ddof(ddof: float) -> float:
    if not isfinite(ddof) or ddof < 0:
        raise ValueError("ddof must be finite and not negative")
    return ddof


# Aggregates.


def mean(x: ColumnLike, weights: ColumnLike | None = None, skipna: bool = True) -> Column:
    if weights is None:
        return if_dense(F.avg(na_in(x)), skipna, x)
    a, w = paired(x, weights)
    total = F.sum(w)
    return if_dense(F.when(total != 0, F.try_divide(F.sum(a * w), total)), skipna, x, weights)


def hmean(x: ColumnLike, weights: ColumnLike | None = None, skipna: bool = True) -> Column:
    a, w = paired(x, 1.0 if weights is None else weights)
    out = F.when(F.min(a) > 0, F.try_divide(F.sum(w), F.sum(F.try_divide(w, a))))
    return if_dense(out, skipna, x)


def gmean(x: ColumnLike, weights: ColumnLike | None = None, skipna: bool = True) -> Column:
    a, w = paired(x, 1.0 if weights is None else weights)
    out = F.when(F.min(a) > 0, F.exp(F.try_divide(F.sum(w * F.ln(a)), F.sum(w))))
    return if_dense(out, skipna, x)


def var(x: ColumnLike, ddof: float = 1, skipna: bool = True) -> Column:
    d = na_in(x)
    n = F.count(d)
    return if_dense(F.when(n > check_ddof(ddof), F.var_pop(d) * n / (n - ddof)), skipna, x)


def stdev(x: ColumnLike, ddof: float = 1, skipna: bool = True) -> Column:
    return F.sqrt(var(x, ddof, skipna))


def covar(x: ColumnLike, y: ColumnLike, ddof: float = 1) -> Column:
    a, b = paired(x, y)
    n = F.count(a)
    return F.when(n > check_ddof(ddof), F.covar_pop(a, b) * n / (n - ddof))


def corr(x: ColumnLike, y: ColumnLike, skipna: bool = True) -> Column:
    a, b = paired(x, y)
    return if_dense(F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b)), skipna, x, y)


def skew(x: ColumnLike, skipna: bool = True) -> Column:
    d = na_in(x)
    return if_dense(F.when(F.count(d) >= 3, F.coalesce(F.skewness(d), F.lit(0.0))), skipna, x)


def kurtosis(x: ColumnLike, skipna: bool = True) -> Column:
    d = na_in(x)
    return if_dense(F.when(F.count(d) >= 4, F.coalesce(F.kurtosis(d), F.lit(0.0))), skipna, x)


def quantile(x: ColumnLike, q: float, skipna: bool = True) -> Column:
    return if_dense(F.percentile(na_in(x), F.lit(check_q(q))), skipna, x)


def median(x: ColumnLike, skipna: bool = True) -> Column:
    return quantile(x, 0.5, skipna)


def percentiles(x: ColumnLike, qs: list[float]) -> Column:
    """An array; of several, those out of range are missing, while one alone raises."""
    if len(qs) == 1:
        check_q(qs[0])
    return F.array(*[F.percentile(na_in(x), F.lit(float(q))) if 0 <= q <= 1 else F.lit(None).cast("double") for q in qs])


# Transforms of a whole series, for withColumn.


def zscore(s: Series, x: ColumnLike, skipna: bool = True) -> Column:
    """Without skipna a missing value empties the series."""
    d = na_in(x)
    sd = F.stddev_samp(d).over(s.all)
    out = F.when(sd != 0, F.try_divide(d - F.avg(d).over(s.all), sd))
    return out if skipna else F.when(F.count(d).over(s.all) == F.count(F.lit(1)).over(s.all), out)


def norminmax(s: Series, x: ColumnLike, skipna: bool = True) -> Column:
    """Without skipna a missing first value empties the series."""
    d = na_in(x)
    lo, hi = F.min(d).over(s.all), F.max(d).over(s.all)
    out = F.when(hi != lo, F.try_divide(d - lo, hi - lo))
    return out if skipna else F.when(F.first(d).over(s.upto).isNotNull(), out)


def per_key(df: DataFrame, s: Series, **made: Column) -> DataFrame:
    """df with aggregates of each key, which has one row of them, joined back."""
    found = df.groupBy(*s.by).agg(*[c.alias(n) for n, c in made.items()])
    return df.join(found, list(s.by))


def winsorize(df: DataFrame, s: Series, x: str, lower: float = 0.05, upper: float = 0.95, skipna: bool = True, name: str = "winsorized") -> DataFrame:
    """df with ``name``: x within its key's bounds. skipna changes nothing: bounds are of the known values, and missing ones stay."""
    if check_q(lower) > check_q(upper):
        raise ValueError("lower must not exceed upper")
    d = na_in(x)
    held = per_key(df, s, __at=F.percentile(d, F.array(F.lit(float(lower)), F.lit(float(upper)))))
    return held.withColumn(name, clamp(d, F.element_at("__at", 1), F.element_at("__at", 2))).drop("__at")


def mad(df: DataFrame, s: Series, x: str, name: str = "mad", skipna: bool = True) -> DataFrame:
    """Mean absolute deviation about the mean per key: two aggregates, combined ahead of the shuffle. Without skipna a missing value empties it."""
    d = na_in(x)
    held = per_key(df, s, __m=F.avg(d))
    return held.groupBy(*s.by).agg(if_dense(F.avg(F.abs(d - F.col("__m"))), skipna, x).alias(name))


# Rolling.


def rollmean(s: Series, x: ColumnLike, p: int, skipna: bool = True) -> Column:
    return s.dense(s.warm(F.avg(na_in(x)).over(s.last(p)), p), skipna, x)


def rollvar(s: Series, x: ColumnLike, p: int, ddof: float = 1, skipna: bool = True) -> Column:
    d = na_in(x)
    n = F.count(d).over(s.last(p))
    out = F.when(n > check_ddof(ddof), F.var_pop(d).over(s.last(p)) * n / (n - ddof))
    return s.dense(s.warm(out, p), skipna, x)


def rollstdev(s: Series, x: ColumnLike, p: int, ddof: float = 1, skipna: bool = True) -> Column:
    return F.sqrt(rollvar(s, x, p, ddof, skipna))


def rollcovar(s: Series, x: ColumnLike, y: ColumnLike, p: int, ddof: float = 1) -> Column:
    a, b = paired(x, y)
    n = F.count(a).over(s.last(p))
    return s.warm(F.when(n >= check_ddof(ddof) + 1, F.covar_pop(a, b).over(s.last(p)) * n / (n - ddof)), p)


def rollcorr(s: Series, x: ColumnLike, y: ColumnLike, p: int, skipna: bool = True) -> Column:
    """Covariance of pairs over the product of each series' own deviation; skipna holds for the deviations."""
    sd = rollstdev(s, x, p, skipna=skipna) * rollstdev(s, y, p, skipna=skipna)
    return F.when(sd > 1e-12, F.try_divide(rollcovar(s, x, y, p), sd))


def rollcorr_of(a: DataFrame, b: DataFrame, s: Series, x: str, y: str, p: int, skipna: bool = True, out_length: str = "min", name: str = "rollcorr") -> DataFrame:
    """rollcorr of x in a with y in b, joined by key and order; out_length: the rows of the shorter series (min) or of the longer (max)."""
    if out_length not in ("min", "max"):
        raise ValueError("out_length must be min or max")
    keys = [*s.by, *s.order]
    both = align(a.select(*keys, x), b.select(*keys, y), keys, "inner" if out_length == "min" else "full")
    return both.withColumn(name, rollcorr(s, x, y, p, skipna))


def rollmedian(s: Series, x: ColumnLike, p: int) -> Column:
    return s.warm(F.percentile(na_in(x), F.lit(0.5)).over(s.last(p)), p)


def rollquantile(s: Series, x: ColumnLike, p: int, q: float) -> Column:
    """An order statistic: the floor((n-1)q)-th value, for even n averaged with the next."""
    check_q(q)
    v = F.array_sort(F.collect_list(na_in(x)).over(s.last(p)))
    n = F.size(v)
    lo = F.floor((n - 1) * q).cast("int") + 1
    a, b = F.try_element_at(v, lo), F.try_element_at(v, F.least(lo + 1, n))
    return s.warm(F.when(n > 0, F.when(n % 2 == 1, a).otherwise((a + b) / 2)), p)


def rollskew(s: Series, x: ColumnLike, p: int) -> Column:
    d = na_in(x)
    w = s.last(p)
    out = F.when(F.var_pop(d).over(w) <= 1e-12, 0.0).otherwise(F.skewness(d).over(w))
    return s.warm(F.when(F.count(d).over(w) >= 3, out), p)


def rollkurtosis(s: Series, x: ColumnLike, p: int) -> Column:
    d = na_in(x)
    w = s.last(p)
    out = F.when(F.var_pop(d).over(w) <= 1e-12, 0.0).otherwise(F.kurtosis(d).over(w))
    return s.warm(F.when(F.count(d).over(w) >= 4, out), p)


# Sampling of rows.


def shuffle(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def sample(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Exactly k rows without replacement (all, if there are fewer)."""
    return df.orderBy(F.rand(seed)).limit(max(0, k))


def bootstrap(df: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows with replacement. Rows are numbered per partition and by partition offsets, so no task sees them all."""
    n = df.count()
    if n == 0 or k <= 0:
        return df.limit(0)
    held = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    sizes = held.groupBy("__p").agg(F.count("*").alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.withColumn("__start", start).drop("__n"))  # a row for each partition
    numbered = held.join(offsets, "__p").withColumn("__i", F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1))
    draws = df.sparkSession.range(k).select(F.floor(F.rand(seed) * n).cast("long").alias("__i"))
    return draws.join(numbered, "__i").drop("__i", "__p", "__m", "__start")


