"""Runs all wanted recurrences of a frame.

Linear ones are scanned by segments (``scan``), so a key's series may be of any length. The
others (t3, kama, stochrsi, directional, psar, supertrend, and those without skipna) run in one
grouped pass: each key's series goes to one Python worker, whose memory bounds its length at
some 10^8 rows. Rows are shuffled by key, and only the columns that the kernels need go along.
Filters on keys belong before this call, since Spark does not push them through it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series, na_in, na_out
from .kernels import KERNELS
from .scan import SCANNED, scanned, scans_of


@dataclass(frozen=True)
class Spec:
    """A kernel of KERNELS with its input columns and parameters."""

    kernel: str
    inputs: tuple[str, ...]
    params: tuple[float, ...] = ()

    def outputs(self, name: str) -> list[str]:
        parts = KERNELS[self.kernel][2]
        return [f"{name}_{p}" for p in parts] if parts else [name]

    def run(self, columns: dict[str, np.ndarray]) -> list[np.ndarray]:
        f, n, parts = KERNELS[self.kernel]
        if len(self.inputs) != n:
            raise ValueError(f"{self.kernel} takes {n} columns")
        got = f(*(columns[c] for c in self.inputs), *self.params)
        return [got[p] for p in parts] if isinstance(got, dict) else got if parts else [got]


def with_recurrences(df: DataFrame, s: Series, specs: dict[str, Spec]) -> DataFrame:
    """df's key and order columns with the outputs of every spec (NULL where missing)."""
    for spec in specs.values():  # bad parameters raise here
        KERNELS[spec.kernel][0](*(np.empty(0) for _ in spec.inputs), *spec.params)
        if len(spec.inputs) != KERNELS[spec.kernel][1]:
            raise ValueError(f"{spec.kernel} takes {KERNELS[spec.kernel][1]} columns")
    linear = {n: x for n, x in specs.items() if x.kernel in SCANNED and not any(isinstance(p, bool) for p in x.params)}
    rest = {n: x for n, x in specs.items() if n not in linear}
    keys = [*s.by, *s.order]
    if not linear:
        return grouped(df, s, rest)
    out = by_scan(df, s, linear)
    if rest:  # the order is unique within a key
        out = out.join(grouped(df, s, rest), keys)
    return out.select(*keys, *[c for name, spec in specs.items() for c in spec.outputs(name)])


def by_scan(df: DataFrame, s: Series, specs: dict[str, Spec]) -> DataFrame:
    keys = [*s.by, *s.order]
    slim = df.select(*keys, *[na_in(c).alias(c) for c in dict.fromkeys(c for spec in specs.values() for c in spec.inputs) if c not in keys])
    parts = {n: scans_of(x.kernel, s, x.inputs, x.params) for n, x in specs.items()}
    scans = {f"__{n}_{i}": scan for n, (found, _) in parts.items() for i, scan in enumerate(found)}
    done = scanned(slim, s, scans)
    value = lambda name, j: F.when(~F.isnan(F.col(name)[j]), F.col(name)[j])
    made = []
    for n, (found, combine) in parts.items():
        values = [[value(f"__{n}_{i}", j) for j in range(scan.steps.width)] for i, scan in enumerate(found)]
        made += [c.alias(name) for c, name in zip(combine(*values), specs[n].outputs(n), strict=True)]
    return done.select(*keys, *made)


def grouped(df: DataFrame, s: Series, specs: dict[str, Spec]) -> DataFrame:
    needed = list(dict.fromkeys(c for spec in specs.values() for c in spec.inputs))
    keys = [*s.by, *s.order]
    made = [c for name, spec in specs.items() for c in spec.outputs(name)]
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), *(f"`{c}` double" for c in made)])

    order = list(s.order)

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        columns = {c: pdf[f"__in_{c}"].to_numpy(np.float64) for c in needed}
        out = pdf[keys].copy()
        for name, spec in specs.items():
            for c, values in zip(spec.outputs(name), spec.run(columns), strict=True):
                out[c] = values
        return out

    slim = df.select(*keys, *[na_out(F.col(c)).alias(f"__in_{c}") for c in needed])
    done = slim.groupBy(*s.by).applyInPandas(run, kinds)
    return done.select(*keys, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in made])
