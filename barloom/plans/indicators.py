"""Indicators over hour bars, in which every look-back fills up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators.numbering import in_parts
from barloom.operators.ranks import ranked, with_first_values, with_tiles
from barloom.plans.bars import hours
from barloom.plans.registry import HOURS, ORACLES, SERIES, query, rounded, rows, shown, when_full

CHANGE = f"close - lag(close) OVER ({SERIES})"


def only(df: DataFrame, *names: str) -> DataFrame:
    """The key and the named columns, rounded."""
    return rounded(df.select("sym", "bar_ts", *names), *names)


@query(f"""{HOURS}, q AS (SELECT *, close / nullif(lag(close) OVER ({SERIES}), 0) AS q1, close / nullif(lag(close, 5) OVER ({SERIES}), 0) AS q5 FROM b)
SELECT sym, bar_ts, {shown(ret1="q1 - 1", ret5="q5 - 1", log1="CASE WHEN q1 > 0 THEN ln(q1) END", mom5=f"close - lag(close, 5) OVER ({SERIES})")} FROM q""")
def ind_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"ret1": ind.simple_return(1), "ret5": ind.simple_return(5), "log1": ind.log_return(1), "mom5": ind.momentum(5)}
    return only(hours(spark, sf_dir).withColumns(made), *made)


@query(f"""{HOURS}, a AS (SELECT *, {when_full("avg(close)", 5)} AS sma5, {when_full("avg(close)", 20)} AS band_mid, {when_full("stddev_samp(close)", 20)} AS dev20,
{when_full("max(high)", 10)} AS channel_high, {when_full("min(low)", 10)} AS channel_low FROM b)
SELECT sym, bar_ts, {shown("sma5", "dev20", "band_mid", "channel_high", "channel_low", band_high="band_mid + 2 * dev20", band_low="band_mid - 2 * dev20")} FROM a""")
def ind_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"sma5": ind.sma(5), "dev20": ind.rolling_std(20), **ind.bands(20, 2.0), **ind.channel(10)}
    return only(hours(spark, sf_dir).withColumns(made), *made)


@query(ORACLES["ind_averages"])
def ind_averages_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each symbol's series cut into parts of 100 bars."""
    made = {"sma5": ind.sma(5), "dev20": ind.rolling_std(20), **ind.bands(20, 2.0), **ind.channel(10)}
    return only(in_parts(hours(spark, sf_dir), lambda df: df.withColumns(made), back=19, part=100), *made)


def ema_sql(source: str, value: str, weight: float, out: str) -> str:
    """A recursive table ``e_<out>`` (sym, rn, y) over a table with sym, rn and the value."""
    return (
        f"e_{out} AS (SELECT sym, rn, {value} AS y FROM {source} WHERE rn = 1 UNION ALL "
        f"SELECT n.sym, n.rn, {weight!r} * {value.replace('x.', 'n.')} + (1 - {weight!r}) * e.y FROM e_{out} e JOIN {source} n ON n.sym = e.sym AND n.rn = e.rn + 1)"
    )


NUMBERED = f"n AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM b)"
RECURSIVE = HOURS.replace("WITH", "WITH RECURSIVE", 1)


@query(f"""{RECURSIVE}, {NUMBERED}, {ema_sql("n", "close", 2 / 13, "a")}, {ema_sql("n", "close", 2 / 27, "b")}
SELECT n.sym, bar_ts, {shown(ema12="a.y", ema26="c.y")} FROM n JOIN e_a a USING (sym, rn) JOIN e_b c USING (sym, rn)""")
def ind_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_ema(hours(spark, sf_dir), 12, 26), "ema12", "ema26")


@query(f"""{RECURSIVE}, {NUMBERED}, {ema_sql("n", "close", 2 / 13, "a")}, {ema_sql("n", "close", 2 / 27, "b")},
m AS (SELECT n.sym, bar_ts, rn, a.y - c.y AS macd FROM n JOIN e_a a USING (sym, rn) JOIN e_b c USING (sym, rn)), {ema_sql("m", "macd", 2 / 10, "s")}
SELECT m.sym, bar_ts, {shown("macd", macd_signal="s.y", macd_hist="macd - s.y")} FROM m JOIN e_s s USING (sym, rn)""")
def ind_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_macd(hours(spark, sf_dir)), "macd", "macd_signal", "macd_hist")


@query(f"""{HOURS}, c AS (SELECT *, {CHANGE} AS d FROM b),
s AS (SELECT *, sum(greatest(d, 0)) OVER {rows(14)} AS up, sum(greatest(-d, 0)) OVER {rows(14)} AS down, count(d) OVER {rows(14)} AS seen FROM c)
SELECT sym, bar_ts, {shown(rsi="CASE WHEN seen = 14 THEN CASE WHEN up + down = 0 THEN 50 ELSE 100 * up / (up + down) END END")} FROM s""")
def ind_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_rsi(hours(spark, sf_dir)), "rsi")


@query(f"""{RECURSIVE}, c AS (SELECT *, {CHANGE} AS d, row_number() OVER ({SERIES}) - 1 AS rn FROM b),
u AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM c WHERE rn > 0), {ema_sql("u", "up", 1 / 14, "a")}, {ema_sql("u", "down", 1 / 14, "b")}
SELECT c.sym, bar_ts, {shown(rsi_wilder="CASE WHEN a.y + x.y = 0 THEN 50 ELSE 100 * a.y / (a.y + x.y) END")} FROM c LEFT JOIN e_a a USING (sym, rn) LEFT JOIN e_b x USING (sym, rn)""")
def ind_rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_rsi_wilder(hours(spark, sf_dir)), "rsi_wilder")


@query(f"""{RECURSIVE}, c AS (SELECT *, {CHANGE} AS d, row_number() OVER ({SERIES}) - 1 AS k FROM b),
m AS (SELECT sym, avg(greatest(d, 0)) AS up, avg(greatest(-d, 0)) AS down FROM c WHERE k BETWEEN 1 AND 14 GROUP BY sym HAVING count(*) = 14),
w AS (SELECT c.sym, k, m.up, m.down FROM c JOIN m USING (sym) WHERE k = 14 UNION ALL
SELECT c.sym, c.k, (13 * w.up + greatest(d, 0)) / 14, (13 * w.down + greatest(-d, 0)) / 14 FROM w JOIN c ON c.sym = w.sym AND c.k = w.k + 1)
SELECT c.sym, bar_ts, {shown(rsi_wilder="CASE WHEN up + down = 0 THEN 50 ELSE 100 * up / (up + down) END")} FROM c LEFT JOIN w USING (sym, k)""")
def ind_rsi_wilder_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilder's own form: the mean of the first 14 changes is the seed."""
    return only(ind.with_rsi_wilder(hours(spark, sf_dir), seed=14), "rsi_wilder")


@query(f"""{HOURS}, r AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({SERIES})), abs(low - lag(close) OVER ({SERIES}))) AS tr FROM b)
SELECT sym, bar_ts, {shown(atr=when_full("avg(tr)", 14))} FROM r""")
def ind_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_atr(hours(spark, sf_dir)), "atr")


@query(f"""{HOURS}, h AS (SELECT *, {when_full("max(high)", 14)} AS hh, {when_full("min(low)", 14)} AS ll FROM b), k AS (SELECT *, 100 * ((close - ll) / nullif(hh - ll, 0)) AS k FROM h)
SELECT sym, bar_ts, {shown(stoch_k="k", stoch_d=f"CASE WHEN count(k) OVER {rows(3)} = 3 THEN avg(k) OVER {rows(3)} END")} FROM k""")
def ind_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_stochastic(hours(spark, sf_dir)), "stoch_k", "stoch_d")


@query(f"{HOURS}, s AS (SELECT *, coalesce(sign({CHANGE}) * volume, 0)::DOUBLE AS step FROM b) SELECT sym, bar_ts, (sum(step) OVER ({SERIES}))::DOUBLE + 0.0 AS obv FROM s")
def ind_obv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_obv(hours(spark, sf_dir)), "obv")


@query(f"""{HOURS}, z AS (SELECT *, {when_full("avg(close)", 20)} AS m, {when_full("stddev_samp(close)", 20)} AS d FROM b)
SELECT sym, bar_ts, {shown(zscore="(close - m) / nullif(d, 0)", pct_rank="percent_rank() OVER (PARTITION BY sym ORDER BY close)")} FROM z""")
def ind_zscore_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(ind.with_percentile_rank(hours(spark, sf_dir).withColumn("zscore", ind.zscore(20))), "zscore", "pct_rank")


RANGE = "OVER (PARTITION BY sym ORDER BY bar_ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)"


@query(f"{HOURS} SELECT sym, bar_ts, count(*) {RANGE} AS bars_6h, max(high) {RANGE} AS high_6h, (sum(volume) {RANGE})::DOUBLE AS volume_6h FROM b")
def ind_last_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"bars_6h": ind.in_last("6 HOURS", "count(1)"), "high_6h": ind.in_last("6 HOURS", "max(high)"), "volume_6h": ind.in_last("6 HOURS", "sum(volume)")}
    return hours(spark, sf_dir).withColumns(made).select("sym", "bar_ts", *made)


@query(f"""{HOURS} SELECT sym, bar_ts, rank() OVER v AS rnk, dense_rank() OVER v AS dense, ntile(4) OVER w AS quarter, {shown(share="cume_dist() OVER v")},
first_value(close) OVER w AS first_close, nth_value(close, 2) OVER w AS second_close FROM b WINDOW v AS (PARTITION BY sym ORDER BY volume), w AS ({SERIES})""")
def ind_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No window holds a whole series: values are ranked in ranges, and rows numbered in buckets of time."""
    by_volume = ranked(hours(spark, sf_dir), "volume", {"rnk": "rank", "dense": "dense_rank", "share": "cume_dist"})
    made = with_first_values(with_tiles(by_volume, 4, "quarter"), "close", {"first_close": 1, "second_close": 2})
    whole = [F.col(name).cast("long").alias(name) for name in ("rnk", "dense", "quarter")]
    return rounded(made.select("sym", "bar_ts", *whole, "share", "first_close", "second_close"), "share")
