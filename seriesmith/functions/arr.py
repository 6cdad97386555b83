"""Missing data and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import ColumnLike, Series, is_na, lit, na_in


def isna(x: ColumnLike) -> Column:
    return is_na(x).cast("double")


def notna(x: ColumnLike) -> Column:
    return (~is_na(x)).cast("double")


def fillna(x: ColumnLike, value: float) -> Column:
    return F.coalesce(na_in(x), F.lit(float(value)))


def ffill(s: Series, x: ColumnLike) -> Column:
    return F.last(na_in(x), ignorenulls=True).over(s.upto)


def bfill(s: Series, x: ColumnLike) -> Column:
    return F.first(na_in(x), ignorenulls=True).over(s.onward)


def replace(x: ColumnLike, old: float, new: float) -> Column:
    """old may be NaN."""
    d = na_in(x)
    return F.coalesce(d, F.lit(float(new))) if old != old else F.when(d == float(old), float(new)).otherwise(d)


def lag(s: Series, x: ColumnLike, shift: int = 1) -> Column:
    """shift < 0 leads, 0 copies; vacated rows are missing."""
    return s.lag(na_in(x), shift)


def dropna(df: DataFrame, x: str) -> DataFrame:
    return df.where(~is_na(x))


def allna(x: ColumnLike) -> Column:
    return F.count(na_in(x)) == 0


def countna(x: ColumnLike) -> Column:
    return F.count_if(is_na(x))


def havena(*xs: ColumnLike) -> Column:
    bad = F.lit(False)
    for x in xs:
        bad = bad | is_na(x)
    return F.coalesce(F.bool_or(bad), F.lit(False))


def equals(a: ColumnLike, b: ColumnLike, precision: int | None = None) -> Column:
    """Aggregate: all rows equal, missing equal to missing."""
    x, y = na_in(a), na_in(b)
    same = F.lit(False) if precision is None else F.coalesce(F.abs(x - y) <= 10.0 ** -precision, F.lit(False))
    return F.coalesce(F.bool_and(x.eqNullSafe(y) | same), F.lit(True))


def align(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two frames by key and position: ``inner`` to the shorter, ``left`` to a's length, ``full`` to the longer."""
    return a.join(b, on, how)


__all__ = ["align", "allna", "bfill", "countna", "dropna", "equals", "ffill", "fillna", "havena", "isna", "lag", "lit", "notna", "replace"]
