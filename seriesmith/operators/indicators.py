"""Indicators that are window expressions: averages, oscillators, trend, volatility, volume and signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.math import mask
from ..functions.series import ColumnLike, Series, check_period, div, is_na, na_in, paired, strict_max, strict_min
from ..functions.stats import rollmean, rollstdev


def weighted(s: Series, x: Column, weights: list[float]) -> Column:
    """Trailing weighted mean, oldest weight first; missing rows leave numerator and weights."""
    v = F.collect_list(F.struct(x.alias("x"))).over(s.last(len(weights)))
    both = F.zip_with(v, F.array(*[F.lit(float(w)) for w in weights]), lambda e, w: F.when(e["x"].isNotNull(), F.struct((e["x"] * w).alias("n"), w.alias("d"))))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    total = F.aggregate(both, zero, lambda a, e: F.when(e.isNull(), a).otherwise(F.struct((a["n"] + e["n"]).alias("n"), (a["d"] + e["d"]).alias("d"))))
    return s.warm(F.when(total["d"] != 0, F.try_divide(total["n"], total["d"])), len(weights))


# Moving averages.


def sma(s: Series, x: ColumnLike, p: int, skipna: bool = True) -> Column:
    return rollmean(s, x, p, skipna)


def wma(s: Series, x: ColumnLike, p: int, skipna: bool = True) -> Column:
    return s.dense(weighted(s, na_in(x), list(range(1, check_period(p) + 1))), skipna, x)


def vwma(s: Series, price: ColumnLike, volume: ColumnLike, p: int, skipna: bool = True) -> Column:
    a, v = paired(price, volume)
    total = F.sum(v).over(s.last(p))
    return s.dense(s.warm(F.when(total != 0, F.try_divide(F.sum(a * v).over(s.last(p)), total)), p), skipna, price, volume)


def trima(s: Series, x: ColumnLike, p: int) -> Column:
    check_period(p)
    d = na_in(x)
    finite = F.when(F.abs(d) < float("inf"), d)
    return weighted(s, finite, [i + 1 if i < (p + 1) // 2 else p - i for i in range(p)])


def hma(s: Series, x: ColumnLike, p: int) -> Column:
    if check_period(p) < 2:
        raise ValueError("period must be at least 2")
    root = int(p**0.5)
    inner = 2 * wma(s, x, p // 2) - wma(s, x, p)
    # The inner series starts at its first known row, the p-th or later.
    outer = weighted(s, inner, list(range(1, root + 1)))
    start = F.min(F.when(inner.isNotNull(), s.rn)).over(s.upto)
    return F.when(s.rn >= start + root - 1, outer)


# Momentum.


def ao(s: Series, h: ColumnLike, l: ColumnLike, short: int = 5, long: int = 34, skipna: bool = True) -> Column:  # noqa: E741
    if check_period(short) >= check_period(long):
        raise ValueError("short must be less than long")
    mid = (na_in(h) + na_in(l)) / 2
    return s.dense(s.warm(sma(s, mid, short) - sma(s, mid, long), long), skipna, h, l)


def aroon(s: Series, h: ColumnLike, l: ColumnLike, p: int, skipna: bool = True) -> list[Column]:  # noqa: E741
    """Up and down. A row's value looks one row ahead, so the last row has none.

    With skipna any missing value empties the series; without, missing values are passed over.
    """
    a, b = na_in(h), na_in(l)
    w = s.between(-check_period(p) + 1, 1)
    full = (s.rn >= p) & F.lead(F.lit(1)).over(s.w).isNotNull()
    if skipna:
        full = full & ~F.max(a.isNull() | b.isNull()).over(s.all)

    def age(best: Column) -> Column:
        at = F.max_by(s.pos, F.when(best.isNotNull(), F.struct(best, s.pos))).over(w)
        return F.when(full, 100.0 * (p - (s.rn - at)) / p)

    return [age(a), age(-b)]


def change(s: Series, x: ColumnLike, p: int) -> Column:
    """A ratio; ``mom`` is the difference."""
    d = na_in(x)
    before = s.lag(d, check_period(p))
    return div(d - before, before)


def roc(s: Series, x: ColumnLike, p: int) -> Column:
    d = na_in(x)
    before = s.lag(d, check_period(p))
    return div(100 * (d - before), before)


def mom(s: Series, x: ColumnLike, p: int) -> Column:
    return na_in(x) - s.lag(na_in(x), check_period(p))


def cmo(s: Series, x: ColumnLike, p: int) -> Column:
    d = na_in(x) - s.lag(na_in(x))
    w = s.last(p)
    up, down = F.sum(F.when(d > 0, d).when(d.isNotNull(), 0.0)).over(w), F.sum(F.when(d < 0, -d).when(d.isNotNull(), 0.0)).over(w)
    return s.warm(F.when(up + down == 0, 0.0).otherwise(F.try_divide(100 * (up - down), up + down)), p + 1)


def kst(s: Series, x: ColumnLike, rocs=(10, 15, 20, 30), means=(10, 10, 10, 15), weights=(1, 2, 3, 4)) -> Column:
    parts = [w * sma(s, roc(s, x, r), n) for r, n, w in zip(rocs, means, weights, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def in_range(c: Column, low: Column, high: Column) -> Column:
    """(c - low) / (high - low), 0 for an empty range."""
    return F.when(high == low, 0.0 * c).otherwise(F.try_divide(c - low, high - low))


def stoch(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, k: int, k_slow: int, d: int) -> list[Column]:  # noqa: E741
    low, high = F.min(na_in(l)).over(s.last(k)), F.max(na_in(h)).over(s.last(k))
    fast = s.warm(100 * in_range(na_in(c), low, high), k)
    slow = sma(s, fast, k_slow)
    start = k + k_slow + d - 2
    return [s.warm(slow, start), s.warm(sma(s, slow, d), start)]


def ultosc(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, periods=(7, 14, 28)) -> Column:  # noqa: E741
    a, b, x = na_in(h), na_in(l), na_in(c)
    prior = s.lag(x)
    bp, true = x - strict_min(b, prior), strict_max(a, prior) - strict_min(b, prior)

    def ratio(p: int) -> Column:
        total = F.sum(true).over(s.last(p))
        return F.when(total == 0, 0.0).otherwise(F.try_divide(F.sum(bp).over(s.last(p)), total))

    one, two, three = (ratio(check_period(p)) for p in periods)
    out = 100 * (4 * one + 2 * two + three) / 7
    return F.when(~s.poison(h, l, c), s.warm(out, max(periods) + 1))


def wpr(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, p: int) -> Column:  # noqa: E741
    low, high = F.min(na_in(l)).over(s.last(p)), F.max(na_in(h)).over(s.last(p))
    x = na_in(c)
    return s.warm(F.when(high == low, 0.0 * x).otherwise(F.try_divide(-100 * (high - x), high - low)), p)


# Trend.


def cci(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, p: int) -> Column:  # noqa: E741
    tp = (na_in(h) + na_in(l) + na_in(c)) / 3
    w = s.last(p)
    ma = F.avg(tp).over(w)
    spread = F.aggregate(F.collect_list(tp).over(w), F.lit(0.0), lambda a, t: a + F.abs(t - ma)) / p
    out = F.when(spread == 0, 0.0).otherwise(F.try_divide(tp - ma, 0.015 * spread))
    return s.warm(F.when(F.count(tp).over(w) == p, out), 2 * p - 1)


def dpo(s: Series, x: ColumnLike, p: int) -> Column:
    return s.lag(na_in(x), p // 2 + 1) - sma(s, x, p)


def middle(s: Series, h: Column, l: Column, p: int) -> Column:  # noqa: E741
    """(highest + lowest) / 2 of a full window without missing values."""
    a, b = paired(h, l)
    w = s.last(p)
    return F.when(F.count(a).over(w) == p, (F.max(a).over(w) + F.min(b).over(w)) / 2)


def ichimoku(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, conversion: int = 9, base: int = 26, span: int = 52) -> list[Column]:  # noqa: E741
    """Tenkan, kijun, senkou A and B (moved forward by base), chikou (close moved back by base)."""
    tenkan, kijun, far = (middle(s, na_in(h), na_in(l), p) for p in (conversion, base, span))
    return [tenkan, kijun, s.lag((tenkan + kijun) / 2, base), s.lag(far, base), s.lag(na_in(c), -base)]


# Volatility.


def tr(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike) -> Column:  # noqa: E741
    a, b, x = na_in(h), na_in(l), na_in(c)
    prior = s.lag(x)
    first = F.when(x.isNotNull(), a - b)
    return F.when(s.rn == 1, first).otherwise(strict_max(a - b, F.abs(a - prior), F.abs(b - prior)))


def bb(s: Series, x: ColumnLike, p: int, mult: float = 2) -> list[Column]:
    mid = sma(s, x, p)
    width = mult * rollstdev(s, x, p, 0)
    return [mid, mid + width, mid - width]


def bbw(s: Series, x: ColumnLike, p: int, mult: float = 2) -> Column:
    mid, up, low = bb(s, x, p, mult)
    return F.when(mid == 0, 0.0).otherwise(F.try_divide(100 * (up - low), mid))


def donchian(s: Series, h: ColumnLike, l: ColumnLike, p: int) -> list[Column]:  # noqa: E741
    a, b = paired(h, l)
    w = s.last(p)
    full = F.count(a).over(w) == p
    up, low = F.when(full, F.max(a).over(w)), F.when(full, F.min(b).over(w))
    return [up, low, (up + low) / 2]


# Volume.


def money_flow(h: ColumnLike, l: ColumnLike, c: ColumnLike, v: ColumnLike) -> Column:  # noqa: E741
    a, b, x, w = na_in(h), na_in(l), na_in(c), na_in(v)
    return F.when(a == b, 0.0 * x * w).otherwise(F.try_divide((x - b) - (a - x), a - b) * w)


def ad(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, v: ColumnLike) -> Column:  # noqa: E741
    flow = money_flow(h, l, c, v)
    return F.when(flow.isNotNull(), F.sum(flow).over(s.upto))


def obv(s: Series, x: ColumnLike, v: ColumnLike) -> Column:
    d, w = na_in(x), na_in(v)
    step = w * F.signum(d - s.lag(d))
    total = F.coalesce(F.sum(step).over(s.upto), F.lit(0.0))
    return F.when(s.rn == 1, 0.0).when(step.isNotNull(), total)


def pnvi(s: Series, c: ColumnLike, v: ColumnLike, start: float = 1000) -> list[Column]:
    """Positive and negative volume index over the rows where close (not 0) and volume are known."""
    x, w = paired(F.when(na_in(c) != 0, na_in(c)), v)
    before = s.between(-(2**31) + 1, -1)
    px, pw = F.last(x, ignorenulls=True).over(before), F.last(w, ignorenulls=True).over(before)
    step = F.try_divide(x, px)
    out = []
    for moved in (w > pw, w < pw):
        factor = F.when(moved & step.isNotNull(), step).when(x.isNotNull(), 1.0)
        out.append(F.when(x.isNotNull(), start * F.product(factor).over(s.upto)))
    return out


def wad(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, skipna: bool = True) -> Column:  # noqa: E741
    """Rows with a missing value, or after a missing close, have none and add nothing.

    Without skipna a close that is missing, or follows one, adds 0, and a missing bound that is
    needed empties the rest.
    """
    a, b, x = na_in(h), na_in(l), na_in(c)
    prior = s.lag(x)
    step = F.when(x > prior, x - strict_min(b, prior)).when(x < prior, x - strict_max(a, prior))
    if not skipna:
        step = step.when((x == prior) | x.isNull() | prior.isNull(), 0.0)
        lost = F.max(step.isNull()).over(s.upto)
        return F.when((s.rn > 1) & ~lost, F.sum(step).over(s.upto))
    step = F.when(a.isNotNull() & b.isNotNull(), step.when(x == prior, 0.0))
    return F.when(step.isNotNull(), F.sum(step).over(s.upto))


def mfi(s: Series, h: ColumnLike, l: ColumnLike, c: ColumnLike, v: ColumnLike, p: int) -> Column:  # noqa: E741
    tp = (na_in(h) + na_in(l) + na_in(c)) / 3
    prior = s.lag(tp)
    raw = tp * na_in(v)
    flow = F.when(tp > prior, raw).when(tp < prior, -raw).when(prior.isNotNull() & raw.isNotNull(), 0.0)
    flow = F.when(F.abs(flow) < float("inf"), flow)
    w = s.last(p)
    up, down = F.sum(F.when(flow > 0, flow).otherwise(0.0)).over(w), F.sum(F.when(flow < 0, -flow).otherwise(0.0)).over(w)
    out = F.when(up + down == 0, 50.0).when(down == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down)))
    return s.warm(F.when(F.count(flow).over(w) == p, out), p + 1)


# Signals: 0/1 masks.


def beyond(s: Series, x: ColumnLike, length: int, up: bool, skipna: bool) -> Column:
    d = na_in(x)
    w = s.between(-check_period(length), -1)
    best = F.max(d).over(w) if up else F.min(d).over(w)
    if not skipna:
        best = F.when(F.count(d).over(w) == length, best)
    now = F.when(d.isNotNull(), F.when(s.rn > length, mask(d > best if up else d < best)).otherwise(0))
    if not skipna:
        return F.coalesce(now, F.lit(0))
    # A missing row repeats the mask before it.
    return F.coalesce(F.last(now, ignorenulls=True).over(s.upto), F.lit(0))


def rising(s: Series, x: ColumnLike, length: int, skipna: bool = True) -> Column:
    """Above every known value of the length rows before."""
    return beyond(s, x, length, True, skipna)


def falling(s: Series, x: ColumnLike, length: int, skipna: bool = True) -> Column:
    return beyond(s, x, length, False, skipna)


def crossover(s: Series, a: ColumnLike, b: ColumnLike) -> Column:
    x, y = na_in(a), na_in(b)
    return mask((x > y) & (s.lag(x) <= s.lag(y)))


def crossunder(s: Series, a: ColumnLike, b: ColumnLike) -> Column:
    x, y = na_in(a), na_in(b)
    return mask((x < y) & (s.lag(x) >= s.lag(y)))


def cross(s: Series, a: ColumnLike, b: ColumnLike, test: Callable[[Column, Column, Column, Column], Column] | None = None) -> Column:
    """test(a, a before, b, b before) may replace the crossing in either direction."""
    x, y = na_in(a), na_in(b)
    px, py = s.lag(x), s.lag(y)
    crossed = test(x, px, y, py) if test else ((x > y) & (px <= py)) | ((x < y) & (px >= py))
    return mask(F.when(~(is_na(x) | is_na(y) | is_na(px) | is_na(py)), crossed))
