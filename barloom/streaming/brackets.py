"""Trades with a stop, a target and a longest time on a stream of ticks, kept by Spark as keyed state.

Ticks wait in the state until the watermark has passed the hour they belong to, which a timer of the event's time
tells; then they are taken in order, whatever batches they came in. They wait as blocks, an Arrow batch a block, and a symbol has a
timer for the earliest of them only: neither ticks nor hours are calls of the state each. Open trades are a list: a trade begins at a
tick that says so, and ends at the first later tick whose price is at most the stop or at least the target, or with the
``longest`` tick behind it. Ticks that come later than the watermark are dropped; without a time, number or price they don't count.
A symbol's ticks are one key, as a trade's end depends on all before it; what is held of it are the ticks that wait, 25 bytes each, and
the open trades, at most ``longest`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.conditions import holds
from barloom.streaming.bars import completed
from barloom.streaming.figures import STATE_STORE, session_with

#: Milliseconds of an hour: so far apart a symbol's timers are.
HOUR = 3_600_000
BLOCK, BLOCKS = "number long", "ticks binary"
TICK = np.dtype([("at", "<i8"), ("seq", "<i8"), ("price", "<f8"), ("enter", "?")])
OPEN = "at long, price double, left int"
#: Trades that are given out at once.
ROWS_AT_ONCE = 100_000
TRADES = "sym string, t_in long, price_in double, t_out long, reason string, ret double"
COLUMNS = [field.split()[0] for field in TRADES.split(", ")]


def hour_end(micros: np.ndarray) -> np.ndarray:
    """The ends of the hours of times, in milliseconds; the end itself belongs to it."""
    return -(-micros // (HOUR * 1000)) * HOUR


class Brackets(StatefulProcessor):
    def __init__(self, stop: float, target: float, longest: int):
        self.stop, self.target, self.longest = stop, target, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks, self.count = handle.getMapState("waiting", BLOCK, BLOCKS), handle.getValueState("blocks", "n long")
        self.open = handle.getListState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, number = None, (self.count.get() or (0,))[0]
        for batch in rows:
            if len(batch):
                ticks = np.empty(len(batch), TICK)
                for name in TICK.names:
                    ticks[name] = batch[name].to_numpy()
                self.blocks.updateValue((number,), (ticks.tobytes(),))
                earliest, number = int(ticks["at"].min()), number + 1
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.count.update((number,))
            self.handle.registerTimer(int(hour_end(first)))
        yield pd.DataFrame([], columns=COLUMNS)

    def waiting(self) -> tuple[np.ndarray, int]:
        """The ticks that wait, in order, and how many blocks they are."""
        number = (self.count.get() or (0,))[0]
        ticks = np.concatenate([np.empty(0, TICK), *[np.frombuffer(self.blocks.getValue((k,))[0], TICK) for k in range(number)]])
        return ticks[np.lexsort([ticks[name] for name in reversed(TICK.names)])], number

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ticks, number = self.waiting()
        due = int(np.searchsorted(hour_end(ticks["at"]), timerValues.getCurrentWatermarkInMs(), "right"))
        if due:
            ended, trades = self.followed(ticks[:due], [tuple(trade) for trade in self.open.get()])
            rest, step = ticks[due:], max(1, -(-len(ticks) // number))
            kept = range(0, len(rest), step)  # the rest is no more blocks than there were
            for k in range(len(kept), number):
                self.blocks.removeKey((k,))
            for k, at in enumerate(kept):
                self.blocks.updateValue((k,), (rest[at : at + step].tobytes(),))
            self.count.update((len(kept),))
            if len(rest):
                self.handle.registerTimer(int(hour_end(rest["at"][0])))
            self.open.put(trades) if trades else self.open.clear()
            for at in range(0, len(ended), ROWS_AT_ONCE):
                part = ended.iloc[at : at + ROWS_AT_ONCE]
                yield part.assign(sym=key[0])[COLUMNS]

    def followed(self, ticks: np.ndarray, trades: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        """The trades that end with ``ticks``, and those that are open then; all trades go on a tick at a time, together."""
        entries, old = np.flatnonzero(ticks["enter"]), np.array(trades, [("at", "<i8"), ("price", "<f8"), ("left", "<i8")])
        at = np.concatenate([np.full(len(old), -1), entries])
        since, paid = (np.concatenate([old[name], ticks[name][entries]]) for name in ("at", "price"))
        left = np.concatenate([old["left"], np.full(len(entries), self.longest)])
        ended, still = [], []
        while len(at):
            at, here = at + 1, at + 1 < len(ticks)
            still += zip(since[~here].tolist(), paid[~here].tolist(), left[~here].tolist(), strict=True)
            at, since, paid, left = at[here], since[here], paid[here], left[here]
            price, low, high = ticks["price"][at], paid * (1 - self.stop), paid * (1 + self.target)
            stopped, reached = price <= low, price >= high
            over = stopped | reached | (left == 1)
            got = np.where(stopped, low, np.where(reached, high, price))[over]
            reason = np.where(stopped, "stop", np.where(reached, "target", "time"))[over].astype(object)
            ret = np.divide(got, paid[over], out=np.full(len(got), np.nan), where=paid[over] != 0) - 1
            ended.append(pd.DataFrame({"t_in": since[over], "price_in": paid[over], "t_out": ticks["at"][at[over]], "reason": reason, "ret": ret}))
            at, since, paid, left = at[~over], since[~over], paid[~over], left[~over] - 1
        return pd.concat(ended, ignore_index=True) if ended else pd.DataFrame([], columns=COLUMNS), still

    def close(self) -> None:
        pass


def stream_brackets(ticks: DataFrame, entry: Column, stop: float, target: float, longest: int, delay: str) -> DataFrame:
    """(sym, t_in, price_in, t_out, reason, ret) of trades that have ended, with times in microseconds; ``entry`` is a condition on a tick."""
    sound = ticks.where("ts is not null and seq is not null and not isnan(coalesce(price, double('NaN')))").withWatermark("ts", delay)
    dealt = sound.select("sym", "ts", F.unix_micros("ts").alias("at"), "seq", "price", holds(entry).alias("enter"))
    return dealt.groupBy("sym").transformWithStateInPandas(statefulProcessor=Brackets(stop, target, longest), outputStructType=TRADES, outputMode="Append", timeMode="EventTime")


def ended_trades(ticks: DataFrame, entry: Column, stop: float, target: float, longest: int, delay: str) -> DataFrame:
    """The trades of a stream that have ended by the watermark when all the input at hand has been read."""
    with session_with(ticks.sparkSession, STATE_STORE):
        made = completed(stream_brackets(ticks, entry, stop, target, longest, delay))
    return made.withColumns({name: F.timestamp_micros(name).cast("timestamp_ntz") for name in ("t_in", "t_out")})
