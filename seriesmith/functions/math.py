"""Element-wise arithmetic, comparisons, reductions, cumulative and rolling operations, least squares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import ColumnLike, Series, check_period, div, is_na, na_in, paired

EPSILON = 2.0**-52
WHOLE = 2.0**53


def add(a: ColumnLike, b: ColumnLike) -> Column:
    return na_in(a) + na_in(b)


def sub(a: ColumnLike, b: ColumnLike) -> Column:
    return na_in(a) - na_in(b)


def mul(a: ColumnLike, b: ColumnLike) -> Column:
    return na_in(a) * na_in(b)


def avg(a: ColumnLike, b: ColumnLike) -> Column:
    return (na_in(a) + na_in(b)) / 2


def scale(x: ColumnLike, by: float) -> Column:
    return na_in(x) * float(by)


def clamp(x: ColumnLike, lo: ColumnLike, hi: ColumnLike) -> Column:
    d, lo, hi = na_in(x), na_in(lo), na_in(hi)
    return F.when(d < lo, lo).when(d > hi, hi).otherwise(d)


def abs_(x: ColumnLike) -> Column:
    return F.abs(na_in(x))


def sign(x: ColumnLike) -> Column:
    return F.signum(na_in(x))


def floor(x: ColumnLike) -> Column:
    d = na_in(x)
    return F.when(F.abs(d) < WHOLE, F.floor(d).cast("double")).otherwise(d)


def ceil(x: ColumnLike) -> Column:
    d = na_in(x)
    return F.when(F.abs(d) < WHOLE, F.ceil(d).cast("double")).otherwise(d)


def round_(x: ColumnLike) -> Column:
    """Halves away from zero."""
    d = na_in(x)
    return F.when(d >= 0, floor(d + 0.5)).otherwise(ceil(d - 0.5))


def mask(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def lt(a: ColumnLike, b: ColumnLike) -> Column:
    return mask(na_in(a) < na_in(b))


def gt(a: ColumnLike, b: ColumnLike) -> Column:
    return mask(na_in(a) > na_in(b))


def lte(a: ColumnLike, b: ColumnLike) -> Column:
    x, y = na_in(a), na_in(b)
    return mask((x < y) | (F.abs(x - y) < EPSILON))


def gte(a: ColumnLike, b: ColumnLike) -> Column:
    x, y = na_in(a), na_in(b)
    return mask((x > y) | (F.abs(x - y) < EPSILON))


def eq(a: ColumnLike, b: ColumnLike) -> Column:
    return mask(F.abs(na_in(a) - na_in(b)) < EPSILON)


def neq(a: ColumnLike, b: ColumnLike) -> Column:
    """Exact; a missing value differs from everything."""
    return F.when(is_na(a) | is_na(b), 1).otherwise((na_in(a) != na_in(b)).cast("int"))


def and_(a: Column, b: Column) -> Column:
    return ((a != 0) & (b != 0)).cast("int")


def or_(a: Column, b: Column) -> Column:
    return ((a != 0) | (b != 0)).cast("int")


def not_(a: Column) -> Column:
    return (a == 0).cast("int")


def diff(s: Series, x: ColumnLike) -> Column:
    return na_in(x) - s.lag(na_in(x))


def apply(x: ColumnLike, f: Callable[[Column], Column]) -> Column:
    """A Column function over the values."""
    return f(na_in(x))


# Reductions: aggregates for groupBy(key).agg(...).


def if_dense(out: Column, skipna: bool, *xs: ColumnLike) -> Column:
    if skipna:
        return out
    bad = is_na(xs[0])
    for x in xs[1:]:
        bad = bad | is_na(x)
    return F.when(~F.bool_or(bad), out)


def sum_(x: ColumnLike, skipna: bool = True) -> Column:
    return if_dense(F.sum(na_in(x)), skipna, x)


def prod(x: ColumnLike, skipna: bool = True) -> Column:
    return if_dense(F.product(na_in(x)), skipna, x)


def min_(x: ColumnLike, skipna: bool = True) -> Column:
    return if_dense(F.min(na_in(x)), skipna, x)


def max_(x: ColumnLike, skipna: bool = True) -> Column:
    return if_dense(F.max(na_in(x)), skipna, x)


def argmin(x: ColumnLike, pos: ColumnLike, skipna: bool = True) -> Column:
    """First position of the minimum, -1 if there is none (infinite values never are)."""
    d, at = na_in(x), pos if isinstance(pos, Column) else F.col(pos)
    ok = d < float("inf")
    return F.coalesce(if_dense(F.min_by(at, F.when(ok, F.struct(d, at))), skipna, x), F.lit(-1))


def argmax(x: ColumnLike, pos: ColumnLike, skipna: bool = True) -> Column:
    d, at = na_in(x), pos if isinstance(pos, Column) else F.col(pos)
    ok = d > float("-inf")
    return F.coalesce(if_dense(F.min_by(at, F.when(ok, F.struct(-d, at))), skipna, x), F.lit(-1))


def dot(x: ColumnLike, y: ColumnLike) -> Column:
    """Missing if any product is; 0 for no rows."""
    return F.when(~F.coalesce(F.bool_or(is_na(x) | is_na(y)), F.lit(False)), F.coalesce(F.sum(na_in(x) * na_in(y)), F.lit(0.0)))


def norm(x: ColumnLike, p: float = 2, skipna: bool = True) -> Column:
    d = na_in(x)
    if p == float("inf"):
        out = F.max(F.abs(d))
    elif p == 1:
        out = F.sum(F.abs(d))
    elif p == 2:
        out = F.sqrt(F.sum(d * d))
    else:
        out = F.pow(F.sum(F.pow(F.abs(d), F.lit(float(p)))), F.lit(1.0 / p))
    return if_dense(out, skipna, x)


def ols(x: ColumnLike, y: ColumnLike) -> Column:
    """Struct of intercept and slope over rows where both are known."""
    a, b = paired(x, y)
    n, sx, sy = F.count(a), F.sum(a), F.sum(b)
    sxx, syy = F.var_pop(a) * n, F.covar_pop(a, b) * n
    slope = F.when(sxx != 0, F.try_divide(syy, sxx))
    return F.struct((F.try_divide(sy, n) - slope * F.try_divide(sx, n)).alias("intercept"), slope.alias("slope"))


def ols_multi(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Coefficients [b0, b1, ...] per key, NULL where the normal equations are singular. Missing values are not skipped.

    One aggregation gives the sums; the small system of a key is solved by elimination.
    """
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    k = len(xs) + 1
    names = {(i, j): f"s{i}_{j}" for i in range(k) for j in range(i, k + 1)}
    sums = df.groupBy(*by).agg(*[F.sum(terms[i] * terms[j]).alias(n) for (i, j), n in names.items()])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf[list(names.values())].to_dict("records"):
                m = np.array([[r[names[min(i, j), max(i, j)]] for j in range(k + 1)] for i in range(k)])
                out.append(eliminate(m))
            yield pdf[by].assign(coefficients=out)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(solve, f"{kinds}, coefficients array<double>")


def eliminate(m: np.ndarray) -> list[float] | None:
    """Solve the augmented system; None if a pivot is under 1e-12."""
    m = m.astype(float).copy()
    for c in range(len(m)):
        p = c + int(np.argmax(np.abs(m[c:, c])))
        if not abs(m[p, c]) >= 1e-12:
            return None
        m[[c, p]] = m[[p, c]]
        m[c] /= m[c, c]
        for r in range(len(m)):
            if r != c:
                m[r] -= m[r, c] * m[c]
    return m[:, -1].tolist()


# Cumulative.


def cumsum(s: Series, x: ColumnLike) -> Column:
    """A missing row shows the running total."""
    return F.coalesce(F.sum(na_in(x)).over(s.upto), F.lit(0.0))


def cumprod(s: Series, x: ColumnLike) -> Column:
    return F.when(~is_na(x), F.product(na_in(x)).over(s.upto))


def cummax(s: Series, x: ColumnLike) -> Column:
    return F.when(~is_na(x), F.max(na_in(x)).over(s.upto))


def cummin(s: Series, x: ColumnLike) -> Column:
    return F.when(~is_na(x), F.min(na_in(x)).over(s.upto))


# Rolling: the trailing p rows, missing before the p-th row.


def rollsum(s: Series, x: ColumnLike, p: int, skipna: bool = True, zero_warmup: bool = False) -> Column:
    """zero_warmup gives 0 instead of missing before the window is full."""
    out = s.warm(F.sum(na_in(x)).over(s.last(p)), p)
    return s.dense(warmup(s, out, p, zero_warmup), skipna, x)


def warmup(s: Series, out: Column, p: int, zero: bool) -> Column:
    return F.when(s.rn < p, 0.0).otherwise(out) if zero else out


def rollprod(s: Series, x: ColumnLike, p: int) -> Column:
    return s.warm(F.product(na_in(x)).over(s.last(p)), p)


def rollmin(s: Series, x: ColumnLike, p: int, zero_warmup: bool = False) -> Column:
    return warmup(s, s.warm(F.min(na_in(x)).over(s.last(p)), p), p, zero_warmup)


def rollmax(s: Series, x: ColumnLike, p: int, zero_warmup: bool = False) -> Column:
    return warmup(s, s.warm(F.max(na_in(x)).over(s.last(p)), p), p, zero_warmup)


def rollminmax(s: Series, low: ColumnLike, high: ColumnLike, p: int, f: Callable[[Column, Column], Column] | None = None) -> Column:
    """Struct of min and max, or f of them."""
    a, b = rollmin(s, low, p), rollmax(s, high, p)
    return f(a, b) if f else F.struct(a.alias("min"), b.alias("max"))


def rollargmin(s: Series, x: ColumnLike, p: int) -> Column:
    """Position of the newest minimum of the last p + 1 rows, from row p on."""
    d = na_in(x)
    check_period(p)
    return s.warm(F.max_by(s_pos(s), F.when(d.isNotNull(), F.struct(-d, s_pos(s)))).over(s.between(-p, 0)), p)


def rollargmax(s: Series, x: ColumnLike, p: int) -> Column:
    d = na_in(x)
    check_period(p)
    return s.warm(F.max_by(s_pos(s), F.when(d.isNotNull(), F.struct(d, s_pos(s)))).over(s.between(-p, 0)), p)


def s_pos(s: Series) -> Column:
    """The position as a column that an aggregate over a window may take: the row's own number."""
    return s.rn - 1


