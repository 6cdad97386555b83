"""Missing values, IEEE arithmetic, and the windows of an ordered series.

A missing value is NaN or NULL in a frame; inside expressions it is NULL, so that Spark's
aggregates skip it. Results are NULL where a value is missing; ``na_out`` gives NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ColumnLike = Column | str | float | int


def lit(x: ColumnLike) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else F.col(x) if isinstance(x, str) else x


def na_in(x: ColumnLike) -> Column:
    """As double, NaN as NULL."""
    d = lit(x).cast("double")
    return F.when(~F.isnan(d), d)


def nan() -> Column:
    return F.lit(float("nan"))


def na_out(x: Column) -> Column:
    return F.coalesce(x.cast("double"), nan())


def is_na(x: ColumnLike) -> Column:
    d = lit(x).cast("double")
    return d.isNull() | F.isnan(d)


def div(a: ColumnLike, b: ColumnLike) -> Column:
    """IEEE division: by zero gives an infinity, or NULL for 0/0; missing if an operand is."""
    a, b = na_in(a), na_in(b)
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def strict_max(*xs: Column) -> Column:
    """NULL if any is."""
    out = F.greatest(*xs)
    for x in xs:
        out = F.when(x.isNotNull(), out)
    return out


def strict_min(*xs: Column) -> Column:
    out = F.least(*xs)
    for x in xs:
        out = F.when(x.isNotNull(), out)
    return out


def check_period(p: int, name: str = "period") -> int:
    if not isinstance(p, int) or p <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return p


@dataclass(frozen=True)
class Series:
    """Rows of each key in a unique order. Every window of one Series shares one sort."""

    by: Sequence[str]
    order: Sequence[str]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def rn(self) -> Column:
        return F.row_number().over(self.w)

    @property
    def pos(self) -> Column:
        return self.rn - 1

    @property
    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    @property
    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def onward(self) -> WindowSpec:
        return self.w.rowsBetween(0, Window.unboundedFollowing)

    def last(self, p: int) -> WindowSpec:
        """The trailing p rows."""
        return self.w.rowsBetween(-(check_period(p) - 1), 0)

    def between(self, a: int, b: int) -> WindowSpec:
        return self.w.rowsBetween(a, b)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.w) if k > 0 else F.lead(x, -k).over(self.w) if k < 0 else x

    def warm(self, x: Column, p: int) -> Column:
        """x from the p-th row on."""
        return F.when(self.rn >= p, x)

    def poison(self, *xs: ColumnLike) -> Column:
        """Whether a missing value has occurred so far: what skipna=False keeps missing to the end."""
        bad = is_na(xs[0])
        for x in xs[1:]:
            bad = bad | is_na(x)
        return F.max(bad).over(self.upto)

    def dense(self, out: Column, skipna: bool, *xs: ColumnLike) -> Column:
        return out if skipna else F.when(~self.poison(*xs), out)


def paired(*xs: ColumnLike) -> list[Column]:
    """Each NULL where any is missing."""
    cols = [na_in(x) for x in xs]
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return [F.when(ok, c) for c in cols]
