"""Recurrences as plain loops over arrays, NaN for missing. No Spark here.

A kernel takes arrays of one series in order and returns a dict of arrays. State is kept
over missing rows unless said otherwise.
"""

from __future__ import annotations

from math import isnan

import numpy as np

NAN = float("nan")


def check(*periods: int) -> None:
    if any(not isinstance(p, int) or p <= 0 for p in periods):
        raise ValueError("period must be a positive integer")


class Ema:
    """Seeded by its first value; ready after p values."""

    def __init__(self, p: int):
        self.k, self.p, self.n, self.value = 2 / (p + 1), p, 0, NAN

    def push(self, x: float) -> float:
        self.value = x if self.n == 0 else self.value + self.k * (x - self.value)
        self.n += 1
        return self.value

    @property
    def ready(self) -> bool:
        return self.n >= self.p


class Rma:
    """Wilder's average, seeded by the mean of p values."""

    def __init__(self, p: int):
        self.p, self.n, self.value, self.total = p, 0, NAN, 0.0

    def push(self, x: float) -> float:
        self.n += 1
        if self.n <= self.p:
            self.total += x
            if self.n == self.p:
                self.value = self.total / self.p
        else:
            self.value = (self.value * (self.p - 1) + x) / self.p
        return self.value


def emptied(out: np.ndarray, skipna: bool, *xs: np.ndarray) -> np.ndarray:
    """out, and without skipna nothing from the first missing input on."""
    bad = np.flatnonzero(np.isnan(sum(xs)))
    if not skipna and len(bad):
        out[bad[0] :] = NAN
    return out


def each(f, *xs: np.ndarray) -> np.ndarray:
    """f over the rows where all xs are known; NaN elsewhere."""
    out = np.full(len(xs[0]), NAN)
    for i, row in enumerate(zip(*(x.tolist() for x in xs), strict=True)):
        if not any(map(isnan, row)):
            out[i] = f(*row)
    return out


def ema(x: np.ndarray, p: int) -> np.ndarray:
    check(p)
    e = Ema(p)

    def step(v: float) -> float:
        e.push(v)
        return e.value if e.ready else NAN

    return each(step, x)


def chained(x: np.ndarray, p: int, depth: int) -> np.ndarray:
    """EMA of EMA ...: each stage is fed once the one before is ready."""
    check(p)
    stages = [Ema(p) for _ in range(depth)]
    out = np.full((depth, len(x)), NAN)
    for i, v in enumerate(x.tolist()):
        if isnan(v):
            continue
        for j, s in enumerate(stages):
            v = s.push(v)
            if not s.ready:
                break
            out[j, i] = v
    return out


def dema(x: np.ndarray, p: int) -> np.ndarray:
    a, b = chained(x, p, 2)
    return 2 * a - b


def tema(x: np.ndarray, p: int) -> np.ndarray:
    a, b, c = chained(x, p, 3)
    return 3 * a - 3 * b + c


def t3(x: np.ndarray, p: int, factor: float = 0.7) -> np.ndarray:
    """Six EMAs, each seeded by the mean of p values of the one before. A missing value after the first result empties the rest."""
    check(p)
    f, k = factor, 2 / (p + 1)
    c1, c2, c3, c4 = -(f**3), 3 * f**2 + 3 * f**3, -6 * f**2 - 3 * f - 3 * f**3, 1 + 3 * f + f**3 + 3 * f**2
    totals, counts, values = [0.0] * 6, [0] * 6, [NAN] * 6
    out = np.full(len(x), NAN)
    started = False
    for i, v in enumerate(x.tolist()):
        if isnan(v):
            if started:
                break
            continue
        for j in range(6):
            if counts[j] < p:
                counts[j] += 1
                totals[j] += v
                if counts[j] < p:
                    break
                values[j] = totals[j] / p
            else:
                values[j] = k * v + (1 - k) * values[j]
            v = values[j]
        else:
            started = True
            out[i] = c1 * values[5] + c2 * values[4] + c3 * values[3] + c4 * values[2]
    return out


def kama(x: np.ndarray, p: int, fast: int = 2, slow: int = 30, skipna: bool = True) -> np.ndarray:
    check(p, fast, slow)
    out = np.full(len(x), NAN)
    rows = np.flatnonzero(~np.isnan(x))
    v = x[rows]
    if len(v) < p + 1:
        return out
    hi, lo = 2 / (fast + 1), 2 / (slow + 1)
    moves = np.abs(np.diff(v))
    value = out[rows[p - 1]] = v[p - 1]
    for i in range(p, len(v)):
        path = moves[i - p : i].sum()
        ratio = abs(v[i] - v[i - p]) / path if path else 0.0
        value += (ratio * (hi - lo) + lo) ** 2 * (v[i] - value)
        out[rows[i]] = value
    return emptied(out, skipna, x)


def rma(x: np.ndarray, p: int, skipna: bool = True) -> np.ndarray:
    check(p)
    r = Rma(p)
    return emptied(each(r.push, x), skipna, x)


def rsi(x: np.ndarray, p: int, skipna: bool = True) -> np.ndarray:
    """Changes are from the last known value."""
    check(p)
    gain, loss, before = Rma(p), Rma(p), NAN

    def step(v: float) -> float:
        nonlocal before
        d, before = v - before, v
        if isnan(d):
            return NAN
        g, b = gain.push(max(d, 0.0)), loss.push(max(-d, 0.0))
        return NAN if isnan(g) else 100.0 if b == 0 else 100 - 100 / (1 + g / b)

    return emptied(each(step, x), skipna, x)


def stochrsi(x: np.ndarray, p: int) -> np.ndarray:
    """Place of the RSI in its last p known values, 0 for an empty range."""
    r = rsi(x, p)
    out = np.full(len(x), NAN)
    rows = np.flatnonzero(~np.isnan(r))
    for i in range(p - 1, len(rows)):
        w = r[rows[i - p + 1 : i + 1]]
        out[rows[i]] = 0.0 if w.max() == w.min() else (w[-1] - w.min()) / (w.max() - w.min())
    return out


def apo(x: np.ndarray, short: int, long: int) -> np.ndarray:
    check(short, long)
    if short >= long:
        raise ValueError("short must be less than long")
    a, b = Ema(short), Ema(long)

    def step(v: float) -> float:
        d = a.push(v) - b.push(v)
        return d if b.ready and b.n > 1 else NAN

    return each(step, x)


def ppo(x: np.ndarray, short: int, long: int) -> np.ndarray:
    check(short, long)
    if short >= long:
        raise ValueError("short must be less than long")
    a, b = Ema(short), Ema(long)

    def step(v: float) -> float:
        d = a.push(v) - b.push(v)
        return (0.0 if b.value == 0 else 100 * d / b.value) if b.ready and b.n > 1 else NAN

    return each(step, x)


def macd(x: np.ndarray, short: int, long: int, signal: int) -> list[np.ndarray]:
    check(short, long, signal)
    out = np.full((3, len(x)), NAN)
    if len(x) < long + signal - 1:
        return list(out)
    a, b, s = Ema(short), Ema(long), Ema(signal)
    for i, v in enumerate(x.tolist()):
        if isnan(v):
            continue
        d = a.push(v) - b.push(v)
        if b.n >= max(long, short) and b.n > 1:
            out[:, i] = d, s.push(d), d - s.value
    return list(out)


def adosc(h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray, short: int, long: int, skipna: bool = True) -> np.ndarray:  # noqa: E741
    check(short, long)
    if short >= long:
        raise ValueError("short must be less than long")
    a, b, total = Ema(short), Ema(long), 0.0

    def step(hi: float, lo: float, x: float, w: float) -> float:
        nonlocal total
        total += 0.0 if hi == lo else ((x - lo) - (hi - x)) / (hi - lo) * w
        d = a.push(total) - b.push(total)
        return d if b.ready else NAN

    return emptied(each(step, h, l, c, v), skipna, h, l, c, v)


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
    if not len(h):
        return np.empty(0)
    prior = np.concatenate([[NAN], c[:-1]])
    out = np.maximum(h - l, np.maximum(np.abs(h - prior), np.abs(l - prior)))
    out[0] = h[0] - l[0] + 0 * c[0]
    return out


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:  # noqa: E741
    return rma(true_range(h, l, c), p)


def natr(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:  # noqa: E741
    with np.errstate(divide="ignore", invalid="ignore"):
        return 100 * atr(h, l, c, p) / c


def keltner(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int, mult: float = 2) -> list[np.ndarray]:  # noqa: E741
    mid, width = ema((h + l + c) / 3, p), mult * atr(h, l, c, p)
    return [mid + 0 * width, mid + width, mid - width]


def directional(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int) -> dict[str, np.ndarray]:  # noqa: E741
    """plus, minus, dx, adx, adxr; a missing value empties the rows after it.

    Where plus and minus are both 0, dx is 0 / 0 and so missing, and there is no adx from there on.
    """
    check(p)
    n = len(h)
    out = {k: np.full(n, NAN) for k in ("plus", "minus", "dx", "adx", "adxr")}
    true = true_range(h, l, c).tolist()
    s_true = s_plus = s_minus = 0.0
    for i in range(n):
        if i:
            up, down = h[i] - h[i - 1], l[i - 1] - l[i]
            missing = isnan(up) or isnan(down) or isnan(true[i])
            plus, minus = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
            if i >= p:
                s_true, s_plus, s_minus = s_true - s_true / p, s_plus - s_plus / p, s_minus - s_minus / p
            s_true, s_plus, s_minus = s_true + true[i], s_plus + (NAN if missing else plus), s_minus + (NAN if missing else minus)
        if i >= p - 1 and s_true:
            a, b = 100 * s_plus / s_true, 100 * s_minus / s_true
            out["plus"][i], out["minus"][i] = a, b
            out["dx"][i] = 100 * abs(a - b) / (a + b) if a + b else NAN
    dx, adx = out["dx"], out["adx"]
    if n > 2 * p - 2:
        adx[2 * p - 2] = dx[p - 1 : 2 * p - 1].mean()
        for i in range(2 * p - 1, n):
            adx[i] = (adx[i - 1] * (p - 1) + dx[i]) / p
            out["adxr"][i] = (adx[i] + adx[i - p + 1]) / 2
    return out


def psar(h: np.ndarray, l: np.ndarray, step: float = 0.02, most: float = 0.2, skipna: bool = True) -> np.ndarray:  # noqa: E741
    """Rows with a missing value are passed over; without skipna they count, and no comparison with a missing value holds."""
    if step <= 0 or step > most:
        raise ValueError("step must be positive and not exceed the maximum")
    out = np.full(len(h), NAN)
    rows = np.flatnonzero(~(np.isnan(h) | np.isnan(l))) if skipna else np.arange(len(h))
    if len(rows) < 2:
        return out
    hi, lo = h[rows].tolist(), l[rows].tolist()
    long = hi[0] + lo[0] <= hi[1] + lo[1]
    sar, best, af = (lo[0], hi[0], step) if long else (hi[0], lo[0], step)
    for k in range(1, len(rows)):
        nxt = sar + af * (best - sar)
        for bound in (max(0, k - 2), k - 1):
            if lo[bound] < nxt if long else hi[bound] > nxt:
                nxt = lo[bound] if long else hi[bound]
        if hi[k] > best if long else lo[k] < best:
            best, af = hi[k] if long else lo[k], min(af + step, most)
        if lo[k] < nxt if long else hi[k] > nxt:
            sar, best, af, long = best, lo[k] if long else hi[k], step, not long
        else:
            sar = nxt
        out[rows[k]] = sar
    return out


def supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, p: int, mult: float) -> list[np.ndarray]:  # noqa: E741
    """Line, upper and lower band, and 1 where the trend is up (0 on missing rows)."""
    a = atr(h, l, c, p)
    out = np.full((3, len(h)), NAN)
    up = np.zeros(len(h))
    upper = lower = NAN
    trend = True
    for i in range(len(h)):
        if isnan(a[i] + h[i] + l[i] + c[i]):
            continue
        mid, width = (h[i] + l[i]) / 2, mult * a[i]
        u, d = mid + width, mid - width
        before = c[i - 1] if i else NAN
        if not isnan(upper):
            u = u if u < upper or before > upper else upper
            d = d if d > lower or before < lower else lower
        trend = True if c[i] > u else False if c[i] < d else trend
        upper, lower = u, d
        out[:, i] = (d if trend else u), u, d
        up[i] = float(trend)
    return [*out, up]


#: name -> (function, input columns, output names)
KERNELS = {
    "ema": (ema, 1, None), "dema": (dema, 1, None), "tema": (tema, 1, None), "t3": (t3, 1, None), "kama": (kama, 1, None), "rma": (rma, 1, None),
    "rsi": (rsi, 1, None), "stochrsi": (stochrsi, 1, None), "apo": (apo, 1, None), "ppo": (ppo, 1, None),
    "macd": (macd, 1, ("line", "signal", "hist")), "adosc": (adosc, 4, None), "atr": (atr, 3, None), "natr": (natr, 3, None),
    "keltner": (keltner, 3, ("mid", "upper", "lower")), "directional": (directional, 3, ("plus", "minus", "dx", "adx", "adxr")),
    "psar": (psar, 2, None), "supertrend": (supertrend, 3, ("line", "upper", "lower", "up")),
}
