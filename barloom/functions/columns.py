"""Column functions: safe ratios, the normal distribution, and the windows of a series."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Coefficients of the approximation 7.1.26 of the error function in Abramowitz and Stegun (error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(column(a), column(b))


def series(*extra: str) -> WindowSpec:
    """A symbol's rows in time. All windows over one key share a shuffle and a sort."""
    return Window.partitionBy("sym", *extra).orderBy("bar_ts")


def last_rows(n: int, *extra: str) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(*extra).rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, *extra: str) -> Column:
    """``value`` where n rows have been seen, else null."""
    return F.when(F.count(F.lit(1)).over(last_rows(n, *extra)) == n, value)


def upper_tail(z: str | Column) -> Column:
    """The probability that a standard normal number is z or more."""
    z = column(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    total = F.lit(0.0)
    for a in reversed(ERF_A):
        total = (total + F.lit(a)) * t
    tail = total * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)
