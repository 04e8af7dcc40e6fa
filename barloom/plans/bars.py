"""Bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.plans.registry import AGGREGATES, DAYS, HOURS, MERGED, TICKS, bars_sql, bucket, query, rounded, shown
from barloom.sources.tables import event_ticks, order_ticks


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(event_ticks(spark, sf_dir), "1 hour")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(event_ticks(spark, sf_dir), "1 day")


@query(f"{DAYS} SELECT * FROM b")
def bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir)


@query(f"WITH {bars_sql('4 hours')} SELECT * FROM b")
def bars_4_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(event_ticks(spark, sf_dir), "4 hours")


@query(
    f"WITH {TICKS}, s AS (SELECT sym, {bucket('1 day')} - to_days(back::INT) AS bar_ts, ts, seq, price, qty FROM t, range(0, 2) r(back)) "
    f"SELECT sym, bar_ts, {AGGREGATES} FROM s GROUP BY ALL"
)
def bars_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(event_ticks(spark, sf_dir), "2 days", slide="1 day")


@query(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY sym ORDER BY ts, seq) + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS broke FROM t),
s AS (SELECT *, sum(broke) OVER (PARTITION BY sym ORDER BY ts, seq) AS session FROM g)
SELECT sym, min(ts) AS bar_ts, max(ts) AS end_ts, {AGGREGATES} FROM s GROUP BY sym, session""")
def bars_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.session_bars(event_ticks(spark, sf_dir), "20 minutes")


@query(f"{DAYS} SELECT sym, {bucket('7 days', 'bar_ts')} AS bar_ts, {MERGED} FROM b GROUP BY sym, {bucket('7 days', 'bar_ts')}")
def bars_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample(days(spark, sf_dir), "7 days")


@query(f"""{HOURS}, s AS (SELECT sym, unnest(generate_series(min(bar_ts), max(bar_ts), INTERVAL 1 HOUR)) AS bar_ts FROM b GROUP BY sym)
SELECT sym, bar_ts, open, high, low, last_value(close IGNORE NULLS) OVER (PARTITION BY sym ORDER BY bar_ts) AS close,
       coalesce(volume, 0) AS volume, coalesce(ticks, 0) AS ticks FROM s LEFT JOIN b USING (sym, bar_ts)""")
def bars_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.forward_fill(bars.fill_calendar(hours(spark, sf_dir), "1 hour"), "close")


ORDER_TICKS = (
    "t AS (SELECT p_brand AS sym, l_shipdate AS ts, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS seq, "
    "l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem JOIN part ON l_partkey = p_partkey)"
)


@query(f"WITH {ORDER_TICKS}, b AS (SELECT sym, date_trunc('month', ts)::TIMESTAMP AS bar_ts, {AGGREGATES} FROM t GROUP BY ALL) SELECT sym, bar_ts, {shown('open', 'high', 'low', 'close', 'volume')}, ticks FROM b")
def bars_order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.calendar_bars(order_ticks(spark, sf_dir), "month"))


@query(f"{HOURS} SELECT sym, bar_ts::DATE AS day, {shown(vwap='sum(close * volume) / sum(volume)')}, sum(volume) AS volume FROM b GROUP BY ALL")
def bars_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.vwap(hours(spark, sf_dir).withColumn("day", F.to_date("bar_ts")), "day"), "vwap")


@query(f"WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY sym ORDER BY ts, seq) - 1) // 50 AS bar FROM t) SELECT sym, bar::BIGINT AS bar, min(ts) AS bar_ts, {AGGREGATES} FROM n GROUP BY sym, bar")
def bars_of_50_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.count_bars(event_ticks(spark, sf_dir), 50)


@query(f"""WITH {ORDER_TICKS}, n AS (SELECT *, floor(coalesce(sum(qty) OVER (PARTITION BY sym ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 5000)::BIGINT AS bar FROM t)
SELECT sym, bar, min(ts) AS bar_ts, {AGGREGATES} FROM n GROUP BY sym, bar""")
def bars_of_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.volume_bars(order_ticks(spark, sf_dir), 5000, "30 days")


@query(f"{HOURS} SELECT count(*) AS bad FROM b WHERE NOT (open BETWEEN low AND high AND close BETWEEN low AND high AND volume >= 0)")
def bars_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.invalid(hours(spark, sf_dir)).agg(F.count(F.lit(1)).alias("bad"))
