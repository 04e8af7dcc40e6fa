"""Running figures of each symbol of a stream, kept by Spark as keyed state that expires.

A symbol's ticks are dealt over a number of keys by their ``seq``, so that one with much of the stream
is many tasks' work; a key's state is one row, into which Arrow batches are folded in any order. ``standing``
puts the keys' last rows together. A key without ticks for the time to live (of the clock, not of ``ts``) starts anew.
Ticks without a time, number or price don't count; a null quantity is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.columns import ratio
from barloom.streaming.bars import completed

#: Keys that a symbol's ticks are dealt over.
PARTS = 8
#: Milliseconds of a month.
MONTH = 30 * 24 * 3_600_000
STATE = "ticks long, qty double, worth double, high double, low double, at long, seq long, last double"
#: What keyed state of one's own needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CONF = STATE_STORE | {
    # state of the clock's time asks for batches without data for ever, and a run over the input at hand would not end
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Figures(StatefulProcessor):
    """One row of STATE a key, given out after each batch with ticks, with the batch's time as ``emitted``."""

    def __init__(self, live: int):
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("figures", STATE, self.live)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks, qty, worth, high, low, *last = self.state.get() or (0, 0.0, 0.0, float("-inf"), float("inf"), -(1 << 63), 0, 0.0)
        last = tuple(last)
        for batch in rows:
            ticks, qty, worth = ticks + len(batch), qty + float(batch["qty"].sum()), worth + float((batch["price"] * batch["qty"]).sum())
            high, low = max(high, float(batch["price"].max())), min(low, float(batch["price"].min()))
            newest = batch.sort_values(["at", "seq"]).iloc[-1]
            last = max(last, (int(newest["at"]), int(newest["seq"]), float(newest["price"])))
        made = (ticks, qty, worth, high, low, *last)
        self.state.update(made)
        yield pd.DataFrame([(*key, timerValues.getCurrentProcessingTimeInMs(), *made)])

    def close(self) -> None:
        pass


def stream_figures(ticks: DataFrame, live: int = MONTH, parts: int = PARTS) -> DataFrame:
    """(sym, part, emitted, figures): what each key's ticks come to so far, after each batch that has some; ``live`` in milliseconds."""
    sound = ticks.where("ts is not null and seq is not null and not isnan(coalesce(price, double('NaN')))")
    dealt = sound.select(
        "sym", F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int").alias("part"), F.unix_micros("ts").alias("at"), "seq", "price", F.coalesce("qty", F.lit(0.0)).alias("qty")
    )
    return dealt.groupBy("sym", "part").transformWithStateInPandas(
        statefulProcessor=Figures(live), outputStructType=f"sym string, part int, emitted long, {STATE}", outputMode="Append", timeMode="ProcessingTime"
    )


def standing(rows: DataFrame) -> DataFrame:
    """(sym, ticks, vwap, high, low, last_ts, last) out of the last row of each key of ``stream_figures``."""
    figures = [name.split()[0] for name in STATE.split(", ")]
    latest = rows.groupBy("sym", "part").agg(F.max_by(F.struct(*figures), "emitted").alias("figures")).select("sym", "figures.*")
    newest = F.max(F.struct("at", "seq", "last"))
    made = latest.groupBy("sym").agg(
        F.sum("ticks").alias("ticks"), ratio(F.sum("worth"), F.sum("qty")).alias("vwap"), F.max("high").alias("high"), F.min("low").alias("low"), newest.alias("newest")
    )
    return made.select("sym", "ticks", "vwap", "high", "low", F.timestamp_micros("newest.at").alias("last_ts"), "newest.last")


@contextmanager
def session_with(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with ``conf`` for the time of a query's start and run."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def running_figures(ticks: DataFrame, live: int = MONTH, parts: int = PARTS) -> DataFrame:
    """What a stream's symbols come to when all the input at hand has been read."""
    with session_with(ticks.sparkSession, CONF):
        return standing(completed(stream_figures(ticks, live, parts)))
