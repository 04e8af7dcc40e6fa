"""Queries by name, and the SQL that says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Digits to which both sides round computed doubles.
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with doubles rounded (all of them if none is named) and no negative zeros."""
    names = names or tuple(name for name, kind in df.dtypes if kind == "double")
    return df.withColumns({name: F.round(name, DIGITS) + F.lit(0.0) for name in names})


def shown(*names: str, **expressions: str) -> str:
    """The same in SQL: a select list of rounded columns."""
    return ", ".join(f"round({expression}, {DIGITS}) + 0.0 AS {name}" for name, expression in ({name: name for name in names} | expressions).items())


# The tables that many queries start from, as SQL.
TICKS = "t AS (SELECT event_type AS sym, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS qty FROM events)"
AGGREGATES = (
    "arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, "
    "sum(qty)::DOUBLE AS volume, count(*) AS ticks"
)
MERGED = "arg_min(open, bar_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_ts) AS close, sum(volume)::DOUBLE AS volume, sum(ticks)::BIGINT AS ticks"


def bucket(every: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{every}', {ts}, TIMESTAMP '1970-01-01')"


def bars_sql(every: str, name: str = "b") -> str:
    return f"{TICKS}, {name} AS (SELECT sym, {bucket(every)} AS bar_ts, {AGGREGATES} FROM t GROUP BY ALL)"


HOURS = f"WITH {bars_sql('1 hour')}"
DAYS = f"WITH {bars_sql('1 day')}"
SERIES = "PARTITION BY sym ORDER BY bar_ts"


def rows(n: int) -> str:
    """An SQL frame of the last n rows."""
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def when_full(expression: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {rows(n)} = {n} THEN {expression} OVER {rows(n)} END"
