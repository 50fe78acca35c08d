"""Column helpers: guarded division, windows over a series, tidy results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def series() -> WindowSpec:
    """The bars of a series in order."""
    return Window.partitionBy("series_id").orderBy("idx")


def over(first: int | None, last: int | None = 0) -> WindowSpec:
    """Rows of a series from ``first`` to ``last`` relative to the current bar; None is unbounded."""
    return series().rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, or 0 where b is (nearly) 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.abs(b) < EPS, F.lit(0.0)).otherwise(a / b)


def case(*branches: tuple[Column, str | Column], otherwise: str | Column | None = None) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(branches[0][0], lit(branches[0][1]))
    for condition, value in branches[1:]:
        out = out.when(condition, lit(value))
    return out.otherwise(lit(otherwise))


def tidy(df: DataFrame, columns: str) -> DataFrame:
    """Select the named columns; those marked ~ are rounded to 7 places."""
    return df.select(*(F.round(c[1:], 7).alias(c[1:]) if c[0] == "~" else F.col(c) for c in columns.split()))
