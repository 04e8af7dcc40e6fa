"""Streaming queries, run over the input at hand."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.registry import AGGREGATES, DAYS, TICKS, query, rounded, shown
from barloom.sources.shared import checkpointed, removed, shared_dir
from barloom.sources.tables import load
from barloom.streaming import bars as streams
from barloom.streaming import brackets, figures, revisions


@query(f"{DAYS} SELECT * FROM b WHERE bar_ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_bars_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars that the watermark has closed."""
    return streams.completed(streams.stream_bars(streams.tick_stream(spark, sf_dir), "1 day", "10 minutes"))


@query(f"{DAYS} SELECT * FROM b")
def stream_bars_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All day bars so far."""
    return streams.completed(streams.stream_bars(streams.tick_stream(spark, sf_dir), "1 day", "10 minutes"), "complete")


@query(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY sym ORDER BY ts, seq) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS broke FROM t),
s AS (SELECT *, sum(broke) OVER (PARTITION BY sym ORDER BY ts, seq) AS session FROM g), m AS (SELECT sym, min(ts) AS bar_ts, max(ts) + INTERVAL 1 HOUR AS end_ts, {AGGREGATES} FROM s GROUP BY sym, session)
SELECT * FROM m WHERE end_ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.completed(streams.stream_session_bars(streams.tick_stream(spark, sf_dir), "1 hour", "10 minutes"))


NUMBERED_TICKS = f"WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts, seq) AS rn FROM t)"


@query(f"""{NUMBERED_TICKS} SELECT a.sym, a.ts, a.seq, round(a.price, 6) + 0.0 AS price,
round(sum(CASE WHEN b.rn = 1 THEN 1 ELSE 2 / 21 END * b.price * pow(19 / 21, a.rn - b.rn)), 6) + 0.0 AS ema FROM n a JOIN n b ON a.sym = b.sym AND b.rn BETWEEN a.rn - 499 AND a.rn GROUP BY ALL""")
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick with its symbol's average so far, out of state. In the SQL what is 500 ticks ago has no weight left."""
    made = streams.completed(streams.stream_ema(streams.tick_stream(spark, sf_dir), 20))
    return rounded(made.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(f"""WITH {TICKS} SELECT sym, count(*) AS ticks, {shown(vwap='sum(price * qty) / sum(qty)')}, max(price) AS high, min(price) AS low, max(ts) AS last_ts,
arg_max(price, row(ts, seq)) AS last FROM t GROUP BY sym""")
def stream_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's ticks, average and last price so far, out of state that expires after a month."""
    made = figures.running_figures(streams.tick_stream(spark, sf_dir))
    return rounded(made.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz")), "vwap")


#: Rows of a file that a part of a stream is written to.
FILE_ROWS = 1_000_000


def _written(spark: SparkSession, parts: list[DataFrame], path: str) -> int:
    """Writes parts one after another, each as equally many files, and returns how many: what one batch of a stream takes."""
    sizes = [part.count() for part in parts]
    files = max(1, min(min(sizes), max(sizes) // FILE_ROWS + 1))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{path}/events.parquet")
    return files


@query(f"{DAYS} SELECT * FROM b WHERE bar_ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches, the last of which brings the first day's once more: too late, so they change nothing."""
    events, path = load(spark, sf_dir, "events"), f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.col("ts") < F.lit(first + (last - first) / 2)
    files = _written(spark, [events.where(middle), events.where(~middle), events.where(F.col("ts") < F.lit(first + dt.timedelta(days=1)))], path)
    made = checkpointed(streams.completed(streams.stream_bars(streams.tick_stream(spark, path, files_per_batch=files), "1 day", "10 minutes")))
    removed(spark, path)
    return made


@query(f"{DAYS} SELECT * FROM b")
def stream_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event of the first half comes last of all: the bars that it belongs to are revised."""
    events, path = load(spark, sf_dir, "events"), f"{shared_dir(spark)}/revised-{uuid.uuid4().hex}"
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    early, late = F.col("ts") < F.lit(first + (last - first) / 2), F.col("event_id") % 5 == 0
    files = _written(spark, [events.where(early & ~late), events.where(~early), events.where(early & late)], path)
    made = revisions.revised_bars(streams.tick_stream(spark, path, files_per_batch=files), "1 day", "60 days")
    removed(spark, path)
    return made.drop("version")


@query(f"""{NUMBERED_TICKS}, l AS (SELECT e.sym, e.rn, e.ts AS t_in, e.price AS price_in, x.rn AS xrn, x.ts, x.price, x.price <= e.price * (1 - 0.3::DOUBLE) AS stopped, x.price >= e.price * (1 + 0.1::DOUBLE) AS reached
FROM n e JOIN n x ON x.sym = e.sym AND x.rn BETWEEN e.rn + 1 AND e.rn + 4 WHERE e.price > 120), f AS (SELECT sym, rn, coalesce(min(xrn) FILTER (stopped OR reached), max(xrn)) AS at_rn FROM l GROUP BY ALL),
d AS (SELECT l.*, CASE WHEN stopped THEN 'stop' WHEN reached THEN 'target' WHEN xrn = l.rn + 4 THEN 'time' END AS reason FROM l JOIN f ON f.sym = l.sym AND f.rn = l.rn AND f.at_rn = xrn)
SELECT sym, t_in, {shown('price_in')}, ts AS t_out, reason, {shown(ret="CASE reason WHEN 'stop' THEN price_in * (1 - 0.3::DOUBLE) WHEN 'target' THEN price_in * (1 + 0.1::DOUBLE) ELSE price END / price_in - 1")}
FROM d WHERE reason IS NOT NULL AND (epoch_us(ts) + 3599999999) // 3600000000 * 3600000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""")
def stream_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades that begin with a high tick and end by a stop, a target or the fourth tick behind it, out of lists and timers of keyed state."""
    return rounded(brackets.ended_trades(streams.tick_stream(spark, sf_dir), F.col("price") > 120, 0.3, 0.1, 4, "10 minutes"))
