"""Linear recurrences over series of any length, by a parallel scan of segments.

An average such as the EMA maps its state before a row to that after it by an affine map, and
so does a segment of rows. Series are cut into segments of about ``SEGMENT_ROWS`` rows by
their first order column. Counts of known rows before each segment come from an aggregate.
Then every segment is reduced to its map by itself, the maps of a key are composed in order
(one small row for each segment), and every segment is run again from the state that it
starts with. No task holds more than a segment, however long a key's series is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from ..functions.series import Series, na_in
from .indicators import money_flow, tr

SEGMENT_ROWS = 100_000

# Steps. Each takes the number n of known rows before, the state (changed in place), and the
# known rows' inputs, and gives the outputs; for given n and inputs the state's change is affine.


def cascade(n: int, s: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """EMA of EMA ...: each is seeded by the first ready value of the one before, and ready after p."""
    k, depth = 2 / (p + 1), len(s)
    out = np.full((depth, len(x)), np.nan)
    for i, v in enumerate(x.tolist()):
        n += 1
        for j in range(depth):
            first = j * (p - 1) + 1
            v = s[j] = v if n == first else s[j] + k * (v - s[j])
            if n < first + p - 1:
                break
            out[j, i] = v
    return out


def side_by_side(n: int, s: np.ndarray, x: np.ndarray, *ps: int) -> np.ndarray:
    """EMAs of one input from the first row on, ready or not; the last state may be a signal, an EMA of the first two's difference."""
    ks = [2 / (p + 1) for p in ps]
    out = np.full((len(s), len(x)), np.nan)
    for i, v in enumerate(x.tolist()):
        n += 1
        for j in range(2):
            s[j] = v if n == 1 else s[j] + ks[j] * (v - s[j])
        first = max(ps[0], ps[1], 2)
        if len(s) > 2 and n >= first:
            d = s[0] - s[1]
            s[2] = d if n == first else s[2] + ks[2] * (d - s[2])
        if n >= first:
            out[:, i] = s
    return out


def flow_emas(n: int, s: np.ndarray, x: np.ndarray, *ps: int) -> np.ndarray:
    """Running total, and two EMAs of it."""
    out = np.full((3, len(x)), np.nan)
    for i, v in enumerate(x.tolist()):
        n += 1
        s[0] += v
        for j, p in enumerate(ps, 1):
            s[j] = s[0] if n == 1 else s[j] + 2 / (p + 1) * (s[0] - s[j])
        if n >= ps[1]:
            out[:, i] = s
    return out


def wilder(n: int, s: np.ndarray, x: np.ndarray, p: int, halves: bool = False) -> np.ndarray:
    """Average seeded by the mean of p values; with halves one of the values above 0 and one of those below."""
    out = np.full((len(s), len(x)), np.nan)
    for i, v in enumerate(x.tolist()):
        n += 1
        for j in range(len(s)):
            part = v if not halves else max(v, 0.0) if j == 0 else max(-v, 0.0)
            s[j] = (s[j] * (p - 1) + part) / p if n > p else (s[j] + part) / p if n == p else s[j] + part
        if n >= p:
            out[:, i] = s
    return out


@dataclass(frozen=True)
class Steps:
    """A step, the width of its state and its parameters."""

    step: Callable[..., np.ndarray]
    width: int
    params: tuple[Any, ...]

    def run(self, n: int, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.array(state, dtype=np.float64)
        return self.step(n, s, x, *self.params), s


@dataclass(frozen=True)
class Scan:
    """Steps over one input."""

    steps: Steps
    input: Column


def scan_of(step: Callable[..., np.ndarray], x: Column, width: int, params: tuple[Any, ...]) -> Scan:
    return Scan(Steps(step, width, params), x)


def scans_of(kernel: str, s: Series, inputs: tuple[str, ...], params: tuple[float, ...]) -> tuple[list[Scan], Callable[..., list[Column]]]:
    """The scans that a kernel needs and the outputs made of theirs (a list of columns for each scan)."""
    x = na_in(inputs[0])
    if kernel in ("ema", "dema", "tema"):
        depth = ("ema", "dema", "tema").index(kernel) + 1
        made = {1: lambda v: [v[0]], 2: lambda v: [2 * v[0] - v[1]], 3: lambda v: [3 * v[0] - 3 * v[1] + v[2]]}[depth]
        return [scan_of(cascade, x, depth, (params[0],))], made
    if kernel == "rma":
        return [scan_of(wilder, x, 1, (params[0],))], lambda v: [v[0]]
    if kernel == "rsi":
        # From the last known value.
        change = x - F.last(x, ignorenulls=True).over(s.w.rowsBetween(Window.unboundedPreceding, -1))
        return [scan_of(wilder, change, 2, (params[0], True))], lambda v: [F.when(v[1] == 0, F.when(v[0].isNotNull(), 100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(v[0], v[1])))]
    if kernel == "apo":
        return [scan_of(side_by_side, x, 2, params)], lambda v: [v[0] - v[1]]
    if kernel == "ppo":
        return [scan_of(side_by_side, x, 2, params)], lambda v: [F.when(v[1] == 0, 0.0).otherwise(F.try_divide(100 * (v[0] - v[1]), v[1]))]
    if kernel == "macd":
        enough = F.count(F.lit(1)).over(s.all) >= params[1] + params[2] - 1
        when = lambda c: F.when(enough, c)
        return [scan_of(side_by_side, x, 3, params)], lambda v: [when(v[0] - v[1]), when(v[2]), when(v[0] - v[1] - v[2])]
    if kernel == "adosc":
        return [scan_of(flow_emas, money_flow(*inputs), 3, params)], lambda v: [v[1] - v[2]]
    true = tr(s, *inputs)
    if kernel == "atr":
        return [scan_of(wilder, true, 1, (params[0],))], lambda v: [v[0]]
    if kernel == "natr":
        c = na_in(inputs[2])
        return [scan_of(wilder, true, 1, (params[0],))], lambda v: [F.when(c != 0, F.try_divide(100 * v[0], c)).when((c == 0) & (v[0] > 0), F.lit(float("inf")))]
    if kernel == "keltner":
        typical = (x + na_in(inputs[1]) + na_in(inputs[2])) / 3
        width = params[1] if len(params) > 1 else 2

        def bands(mid: list[Column], range_: list[Column]) -> list[Column]:
            return [F.when(range_[0].isNotNull(), mid[0]), mid[0] + width * range_[0], mid[0] - width * range_[0]]

        return [scan_of(cascade, typical, 1, (params[0],)), scan_of(wilder, true, 1, (params[0],))], bands
    raise KeyError(kernel)


#: Kernels that are scanned; the others keep a state that is no affine map.
SCANNED = {"ema", "dema", "tema", "rma", "rsi", "apo", "ppo", "macd", "adosc", "atr", "natr", "keltner"}


def with_segments(df: DataFrame, s: Series) -> DataFrame:
    """df with ``__seg``: a number that rises along the order, so that rows of one number are about SEGMENT_ROWS at most if the order is even."""
    kind = df.schema[s.order[0]].dataType
    at = F.col(s.order[0])
    if isinstance(kind, TimestampNTZType | DateType):
        at = at.cast("timestamp")
    elif not isinstance(kind, NumericType | TimestampType):
        return df.withColumn("__seg", F.lit(0).cast("long"))
    at = at.cast("double")
    sizes = df.groupBy(*s.by).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"), F.ceil(F.count("*") / SEGMENT_ROWS).alias("__segs"))  # one row a key
    place = F.floor(F.try_divide((at - F.col("__lo")) * F.col("__segs"), F.col("__hi") - F.col("__lo")))
    held = df.join(sizes, list(s.by)) if s.by else df.crossJoin(sizes)
    return held.withColumn("__seg", F.coalesce(F.least(place, F.col("__segs") - 1), F.lit(0)).cast("long")).drop("__lo", "__hi", "__segs")


def scanned(df: DataFrame, s: Series, scans: dict[str, Scan]) -> DataFrame:
    """df (any columns) with, for each scan, an array column of its outputs: missing where the input is, or they are not ready."""
    by, order, names, columns = list(s.by), list(s.order), list(scans), df.columns
    steps = {n: x.steps for n, x in scans.items()}
    cut = with_segments(df.select("*", *[x.input.alias(f"__in_{n}") for n, x in scans.items()]), s)
    before = Window.partitionBy(*by).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "__seg").agg(*[F.count(f"__in_{n}").alias(f"__c_{n}") for n in names])
    counts = counts.select(*by, "__seg", *[F.coalesce(F.sum(f"__c_{n}").over(before), F.lit(0)).alias(f"__n_{n}") for n in names])
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    numbers = ", ".join([*kinds, "__seg long", *(f"__n_{n} long" for n in names)])

    def known(pdf: pd.DataFrame, n: str) -> tuple[np.ndarray, np.ndarray]:
        x = pdf[f"__in_{n}"].to_numpy(np.float64)
        rows = np.flatnonzero(~np.isnan(x))
        return rows, x[rows]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = pdf.iloc[:1][[*by, "__seg", *(f"__n_{n}" for n in names)]].copy()
        for n, scan in steps.items():
            _, x = known(pdf, n)
            start = int(out[f"__n_{n}"].iloc[0])
            shift = scan.run(start, np.zeros(scan.width), x)[1]
            turns = [scan.run(start, unit, x)[1] - shift for unit in np.eye(scan.width)]
            out[f"__m_{n}"] = [np.concatenate([shift, *turns]).tolist()]
        return out

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__seg")
        out = pdf[[*by, "__seg", *(f"__n_{n}" for n in names)]].copy()
        for n, scan in steps.items():
            state, starts = np.zeros(scan.width), []
            for m in pdf[f"__m_{n}"]:
                starts.append(state.tolist())
                m = np.asarray(m).reshape(scan.width + 1, scan.width)
                state = m[0] + state @ m[1:]
            out[f"__s_{n}"] = starts
        return out

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = pdf[columns].copy()
        for n, scan in steps.items():
            rows, x = known(pdf, n)
            values = np.full((len(pdf), scan.width), np.nan)
            values[rows] = scan.run(int(pdf[f"__n_{n}"].iloc[0]), np.asarray(pdf[f"__s_{n}"].iloc[0]), x)[0].T
            out[n] = list(values)
        return out

    told = cut.select(*by, *order, "__seg", *[f"__in_{n}" for n in names]).join(counts, [*by, "__seg"])
    maps = told.groupBy(*by, "__seg").applyInPandas(reduce, numbers + "".join(f", __m_{n} array<double>" for n in names))
    starts = maps.groupBy(*by).applyInPandas(compose, numbers + "".join(f", __s_{n} array<double>" for n in names))
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    done = cut.join(starts, [*by, "__seg"]).groupBy(*by, "__seg").applyInPandas(replay, whole + "".join(f", `{n}` array<double>" for n in names))
    return done
