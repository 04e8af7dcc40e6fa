"""Conditions: named booleans of a bar, in wide form (columns) and long form (one row for each that holds)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import column, last_rows, series


def holds(condition: Column) -> Column:
    """The condition, with unknown taken as not satisfied."""
    return F.coalesce(condition, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def negate(condition: Column) -> Column:
    return ~condition


def cross_above(a: str | Column, b: str | Column) -> Column:
    """a is above b, and was not on the bar before."""
    a, b = column(a), column(b)
    return (a > b) & (F.lag(a).over(series()) <= F.lag(b).over(series()))


def cross_below(a: str | Column, b: str | Column) -> Column:
    return cross_above(b, a)


def persist(condition: str | Column, n: int) -> Column:
    """It held on each of the last n bars; unknown before n bars were seen."""
    held = holds(column(condition)).cast("int")
    return F.when(F.count(F.lit(1)).over(last_rows(n)) == n, F.min(held).over(last_rows(n)) == 1)


def recent(condition: str | Column, n: int) -> Column:
    """It held on at least one of the last n bars."""
    return F.max(holds(column(condition)).cast("int")).over(last_rows(n)) == 1


def doji(share: float = 0.1) -> Column:
    """Open and close are close together compared with the range."""
    return F.abs(F.col("close") - F.col("open")) <= share * (F.col("high") - F.col("low"))


def inside_bar() -> Column:
    """The bar stays strictly within the one before."""
    return (F.col("high") < F.lag("high").over(series())) & (F.col("low") > F.lag("low").over(series()))


def _engulfing(rising: bool) -> Column:
    before = {name: F.lag(name).over(series()) for name in ("open", "close")}
    (low, high), (old_low, old_high) = (("open", "close"), ("close", "open")) if rising else (("close", "open"), ("open", "close"))
    turned = (F.col(high) > F.col(low)) & (before[old_low] < before[old_high])
    return turned & (F.col(low) <= before[old_low]) & (F.col(high) >= before[old_high])


def bullish_engulfing() -> Column:
    """A rising body that covers the falling body before it."""
    return _engulfing(True)


def bearish_engulfing() -> Column:
    """A falling body that covers the rising body before it."""
    return _engulfing(False)


PATTERNS = {"doji": doji, "inside_bar": inside_bar, "bullish_engulfing": bullish_engulfing, "bearish_engulfing": bearish_engulfing}


def pattern(name: str) -> Column:
    return PATTERNS[name]()


def with_conditions(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``df`` with a boolean column for each condition, never null."""
    return df.withColumns({name: holds(condition) for name, condition in conditions.items()})


def held(names: Iterable[str]) -> Column:
    """The names of the conditions that hold on a bar, as an array."""
    names = list(names)
    if not names:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(F.col(name), F.lit(name)) for name in names]), lambda name: name.isNotNull())


def long_form(df: DataFrame, names: Iterable[str], *carried: str) -> DataFrame:
    """(sym, bar_ts, cond, carried columns): one row for each condition that holds."""
    return df.select("sym", "bar_ts", F.explode(held(names)).alias("cond"), *carried)
