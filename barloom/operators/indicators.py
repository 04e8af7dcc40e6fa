"""Indicators: columns over a symbol's bars, from the current bar and those before it.

All with a bounded look-back are windows over (sym, bar_ts), which Spark evaluates in one shuffle
and one sort however many there are, a task a symbol: from some ten million bars a symbol on, work them out by
``numbering.in_parts``. Values are null until their look-back is full; recursive ones
have a value from their seed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.columns import column, full, last_rows, ratio, series
from barloom.operators.joins import broadcast_up_to
from barloom.operators.ranks import ranked
from barloom.operators.scans import HOURS, Running, scanned
from barloom.sources.shared import checkpointed

#: Rows of a block in which values are smoothed from 0, and so many blocks' starts are broadcast at most.
BLOCK, BROADCAST_BLOCKS = 512, 200_000


def previous(value: str | Column = "close", k: int = 1) -> Column:
    return F.lag(column(value), k).over(series())


def simple_return(k: int = 1, value: str = "close") -> Column:
    return ratio(value, previous(value, k)) - 1


def log_return(k: int = 1, value: str = "close") -> Column:
    """Null where either price is not positive."""
    quotient = ratio(value, previous(value, k))
    return F.when(quotient > 0, F.ln(quotient))


def momentum(k: int, value: str = "close") -> Column:
    return column(value) - previous(value, k)


def sma(n: int, value: str | Column = "close") -> Column:
    return full(F.avg(column(value)).over(last_rows(n)), n)


def rolling_std(n: int, value: str | Column = "close") -> Column:
    return full(F.stddev_samp(column(value)).over(last_rows(n)), n)


def bands(n: int, k: float, value: str = "close") -> dict[str, Column]:
    """The mean and k deviations to each side of it."""
    return {"band_mid": sma(n, value), "band_high": sma(n, value) + k * rolling_std(n, value), "band_low": sma(n, value) - k * rolling_std(n, value)}


def channel(n: int) -> dict[str, Column]:
    """The highest high and lowest low of n bars."""
    return {"channel_high": full(F.max("high").over(last_rows(n)), n), "channel_low": full(F.min("low").over(last_rows(n)), n)}


def rsi(n: int = 14) -> Column:
    """100 times the share of rises in all changes, simple average; 50 where nothing changed."""
    change = F.col("close") - F.col("__previous")
    rise, fall = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))
    up, down = F.sum(rise).over(last_rows(n)), F.sum(fall).over(last_rows(n))
    seen = F.count("__previous").over(last_rows(n)) == n
    return F.when(seen, F.when(up + down == 0, 50.0).otherwise(100 * ratio(up, up + down)))


def with_rsi(df: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    return df.withColumn("__previous", previous()).withColumn(name, rsi(n)).drop("__previous")


def true_range(before: str | Column) -> Column:
    """The bar's range, stretched to the close before it."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - column(before)), F.abs(F.col("low") - column(before)))


def with_atr(df: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    """The true range's simple average; the first bar's is its own range."""
    ranged = df.withColumn("__range", true_range(previous()))
    return ranged.withColumn(name, full(F.avg("__range").over(last_rows(n)), n)).drop("__range")


def with_stochastic(df: DataFrame, n: int = 14, m: int = 3) -> DataFrame:
    """%K: where the close stands in the channel, 0 to 100; %D: its average over m bars."""
    high, low = channel(n).values()
    made = df.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low))
    known = F.count("stoch_k").over(last_rows(m)) == m
    return made.withColumn("stoch_d", F.when(known, F.avg("stoch_k").over(last_rows(m))))


def with_obv(df: DataFrame, hours: int = HOURS) -> DataFrame:
    """On-balance volume: volume added on rises and taken off on falls, worked out in buckets of ``hours``."""
    step = F.coalesce(F.signum(F.col("close") - F.col("__previous")) * F.col("volume"), F.lit(0.0))
    before = scanned(df, previous={"__previous": "close"}, hours=hours)
    return scanned(before, {"obv": Running("sum", step)}, hours=hours).drop("__previous")


def zscore(n: int, value: str = "close") -> Column:
    return ratio(F.col(value) - sma(n, value), rolling_std(n, value))


def with_percentile_rank(df: DataFrame, value: str = "close", name: str = "pct_rank") -> DataFrame:
    """``df`` with each bar's place among all of its symbol's bars, 0 to 1 (looks at the whole series)."""
    return ranked(df, value, {name: "percent_rank"})


def in_last(interval: str, aggregate: str) -> Column:
    """An SQL aggregate over the bars of the last ``interval`` of time, the current one included."""
    return F.expr(f"{aggregate} OVER (PARTITION BY sym ORDER BY bar_ts RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")


class Smooth(NamedTuple):
    """A smoothed column: y = weight * x + (1 - weight) * y before, from the mean of the first ``seed`` values of x on."""

    name: str
    source: Column
    weight: float
    seed: int = 1


def _carried(steps: list[tuple[float, int]]):
    """What each block of a series starts from, out of the blocks' ends in time order; only a few numbers a series go on from row to row."""

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = object(), []
        for batch in batches:
            out = {f"__{what}{i}": [] for i in range(len(steps)) for what in ("carry", "before")}
            for row in batch.itertuples(index=False):
                sym = None if pd.isna(row[0]) else row[0]
                if sym != series:
                    series, state = sym, [(0.0, 0, [], None) for _ in steps]
                for i, (weight, seed) in enumerate(steps):
                    local, count, head = row[3 + 3 * i : 6 + 3 * i]
                    z, before, first, start = state[i]
                    decay = 1 - weight
                    if start is None:
                        first = [*first, *head][:seed]
                        if len(first) == seed:
                            scanned = sum(weight * x * decay ** (seed - 1 - k) for k, x in enumerate(first))
                            start = (sum(first) / seed - scanned, seed)
                    value = z if start is None else z + start[0] * (decay ** (before - start[1]) if decay or before >= start[1] else 0.0)
                    out[f"__carry{i}"].append(value)
                    out[f"__before{i}"].append(before)
                    state[i] = (local + decay**count * z, before + count, first, start)
            yield batch.iloc[:, :3].assign(**out)

    return carry


def smoothed(df: DataFrame, steps: list[Smooth], order: tuple[str, ...] = ("bar_ts",), ts: str = "bar_ts", hours: int = 720) -> DataFrame:
    """``df`` with exponentially smoothed columns, which a window function alone can't have, as it doesn't see its own earlier output.

    A symbol's rows are cut into blocks of ``BLOCK`` rows at most, within buckets of ``hours``. Inside a block
    smoothing from 0 is a running sum of decayed values; one row a block then tells what the block
    starts from, which is added with its decay. So a symbol of any length is smoothed by many tasks, and only
    its blocks' ends pass through one. A null or NaN x keeps the value before it; y is null until ``seed`` values have been seen.
    """
    rates = [-math.log(1 - step.weight) for step in steps if step.weight < 1]
    rows = min([BLOCK, *(max(1, int(600 / rate)) for rate in rates)])
    inside, block = Window.partitionBy("sym", "__bucket").orderBy(*order), Window.partitionBy("sym", "__bucket", "__sub").orderBy(*order)
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(hours * 3_600_000_000))).withColumn("__sub", F.floor((F.row_number().over(inside) - 1) / rows).cast("int"))
    sources = {f"__x{i}": F.when(~F.isnan(step.source), step.source.cast("double")) for i, step in enumerate(steps)}
    marked = marked.withColumns(sources).withColumns({f"__k{i}": F.count(f"__x{i}").over(so_far) for i in range(len(steps))} | {"__row": F.row_number().over(block)})
    local = {}
    for i, step in enumerate(steps):
        x, k, decay = F.col(f"__x{i}"), F.col(f"__k{i}"), F.lit(1 - step.weight)
        if step.weight == 1:
            local[f"__local{i}"] = F.coalesce(F.last(x, ignorenulls=True).over(so_far), F.lit(0.0))
        else:
            local[f"__local{i}"] = F.pow(decay, k) * F.coalesce(F.sum(x * F.lit(step.weight) * F.pow(decay, -k)).over(so_far), F.lit(0.0))
    marked = checkpointed(marked.withColumns(local))  # what follows reads it twice
    keys, ends = ["sym", "__bucket", "__sub"], []
    for i, step in enumerate(steps):
        first = F.sort_array(F.collect_list(F.when(F.col(f"__x{i}").isNotNull() & (F.col(f"__k{i}") <= step.seed), F.struct(f"__k{i}", f"__x{i}"))))
        ends += [F.max_by(f"__local{i}", "__row").alias(f"__local{i}"), F.max(f"__k{i}").alias(f"__k{i}"), first[f"__x{i}"].alias(f"__head{i}")]
    blocks = marked.groupBy(*keys).agg(*ends).repartition("sym").sortWithinPartitions(*keys)
    schema = T.StructType([*[marked.schema[name] for name in keys]])
    for i in range(len(steps)):
        schema = schema.add(f"__carry{i}", T.DoubleType()).add(f"__before{i}", T.LongType())
    starts = blocks.mapInPandas(_carried([(step.weight, step.seed) for step in steps]), schema)
    starts = starts.withColumnsRenamed({name: f"{name}_of" for name in keys})
    met = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}_of")) for name in keys])
    made = []
    for i, step in enumerate(steps):
        value = F.col(f"__local{i}") + F.pow(F.lit(1 - step.weight), F.col(f"__k{i}")) * F.col(f"__carry{i}")
        made.append(F.when(F.col(f"__before{i}") + F.col(f"__k{i}") >= step.seed, value).alias(step.name))
    return marked.join(broadcast_up_to(checkpointed(starts), BROADCAST_BLOCKS), met).select(*df.columns, *made)


def ema_step(n: int, source: str = "close", name: str | None = None) -> Smooth:
    """The usual exponential average of n bars: weight 2 / (n + 1)."""
    return Smooth(name or f"ema{n}", F.col(source), 2 / (n + 1))


def with_ema(df: DataFrame, *lengths: int) -> DataFrame:
    return smoothed(df, [ema_step(n) for n in lengths])


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Fast minus slow average (``macd``), its own average (``macd_signal``) and what is between them (``macd_hist``); without a close all three stay as they were."""
    line = F.col("__fast") - F.col("__slow")
    if signal in (fast, slow):
        made = smoothed(df, [ema_step(fast, name="__fast"), ema_step(slow, name="__slow")]).withColumn("macd", line)
        known = F.col("close").isNotNull() & ~F.isnan("close")
        made = smoothed(made, [ema_step(signal, name="macd_signal")._replace(source=F.when(known, F.col("macd")))])
    else:
        # an average of an average is a difference of the two averages of the series itself, so one pass does
        made = smoothed(df, [ema_step(fast, name="__fast"), ema_step(slow, name="__slow"), ema_step(signal, name="__signal")])
        weight, kept = 2 / (signal + 1), 1 - 2 / (signal + 1)
        again = lambda n, name: (F.lit(2 / (n + 1) * kept) * F.col("__signal") - F.lit(weight * (1 - 2 / (n + 1))) * F.col(name)) / F.lit(kept - 1 + 2 / (n + 1))
        made = made.withColumns({"macd": line, "macd_signal": again(fast, "__fast") - again(slow, "__slow")})
    return made.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow", "__signal")


def with_rsi_wilder(df: DataFrame, n: int = 14, seed: int = 1) -> DataFrame:
    """RSI over changes smoothed with weight 1 / n, from the mean of the first ``seed`` changes on: n in Wilder's own form, 1 for a value from the first change on."""
    changes = df.withColumn("__change", F.col("close") - previous())
    rise, fall = F.greatest(F.col("__change"), F.lit(0.0)), F.greatest(-F.col("__change"), F.lit(0.0))
    known = F.col("__change").isNotNull()
    steps = [Smooth("__up", F.when(known, rise), 1 / n, seed), Smooth("__down", F.when(known, fall), 1 / n, seed)]
    up, down = F.col("__up"), F.col("__down")
    value = F.when(up + down == 0, 50.0).otherwise(100 * ratio(up, up + down))
    return smoothed(changes, steps).withColumn("rsi_wilder", F.when(up.isNotNull(), value)).drop("__change", "__up", "__down")
