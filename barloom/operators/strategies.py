"""Strategies: from conditions to positions, trades, equity and figures, and searching a grid of them.

A signal is 1 (enter), 0 (leave) or null (keep). Positions act on the bar after their signal.
Frames take ``extra`` keys (a strategy's parameters) beside the symbol; a table dealt by symbol
serves windows over (symbol, strategy) without another shuffle. Without such keys a series may have any length: it is
worked out in buckets of ``hours``, which should hold as many of a symbol's bars as suit a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import full, last_rows, ratio, series
from barloom.operators.conditions import holds
from barloom.operators.joins import broadcast_up_to
from barloom.operators.numbering import cells_of_range
from barloom.operators.ranks import numbered, with_tiles
from barloom.operators.scans import HOURS, Running, scanned
from barloom.sources.shared import checkpointed

#: What is left at least after a bar: a loss of everything counts as one down to this share.
LEAST_LEFT = 1e-9
#: Bars that are looked ahead at as a frame at most; a node of the tree of extremes holds two to this power of those below; symbols that are broadcast at most.
FRAME, TREE_BITS, BROADCAST_SYMBOLS = 64, 3, 100_000
#: From so many pairs on, a grid is dealt by symbol and pair, so that one symbol's pairs run side by side.
DEAL_FROM = 16


def signal(entry: Column, leave: Column) -> Column:
    """Leaving wins where both hold."""
    return F.when(holds(leave), 0).when(holds(entry), 1)


def _running(df: DataFrame, extra: Sequence[str], hours: int, running: Mapping[str, Running] | None = None, previous: Mapping[str, str] | None = None) -> DataFrame:
    """``scanned`` in buckets of ``hours``; strategies of a grid (``extra`` keys) stay where their bars were dealt, as windows over (symbol, strategy)."""
    if not extra:
        return scanned(df, running, previous, hours=hours)
    so_far = series(*extra).rowsBetween(Window.unboundedPreceding, 0)
    plain = {"last": lambda x: F.last(x, ignorenulls=True).over(so_far), "sum": lambda x: F.sum(x).over(so_far)}
    for name, run in (running or {}).items():
        df = df.withColumn(name, plain[run.kind](run.source))
    return df.withColumns({name: F.lag(source).over(series(*extra)) for name, source in (previous or {}).items()})


def with_position(df: DataFrame, entry: Column, leave: Column, *extra: str, hours: int = HOURS) -> DataFrame:
    """``df`` with ``sig``, ``wanted`` (the position that the signal asks for) and ``pos`` (one bar later)."""
    signalled = df.withColumn("sig", signal(entry, leave))
    made = _running(signalled, extra, hours, {"wanted": Running("last", F.col("sig"))}, {"pos": "wanted"})
    return made.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("wanted", "pos")})


def with_profit(df: DataFrame, bps: float = 0.0, *extra: str, hours: int = HOURS) -> DataFrame:
    """``df`` with ``pnl``: the position times the bar's return, less what changing the position costs."""
    before = _running(df, extra, hours, previous={"__close": "close", "__pos": "pos"})
    change = F.coalesce(ratio("close", "__close") - 1, F.lit(0.0))
    cost = F.abs(F.col("pos") - F.coalesce("__pos", F.lit(0))) * F.lit(bps / 10_000)
    return before.withColumn("pnl", F.col("pos") * change - cost).drop("__close", "__pos")


def trades(df: DataFrame, *extra: str, hours: int = HOURS) -> DataFrame:
    """(sym, trade_id, t_in, t_out, n, pnl): runs of bars in a position; a trade open at the end is included."""
    entered = ((F.col("pos") != 0) & (F.coalesce("__pos", F.lit(0)) == 0)).cast("int")
    numbered = _running(_running(df, extra, hours, previous={"__pos": "pos"}), extra, hours, {"trade_id": Running("sum", entered)})
    return numbered.where("pos <> 0").groupBy("sym", *extra, "trade_id").agg(
        F.min("bar_ts").alias("t_in"), F.max("bar_ts").alias("t_out"), F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl")
    )


def log_growth() -> Column:
    return F.ln(F.greatest(1 + F.col("pnl"), F.lit(LEAST_LEFT)))


def with_equity(df: DataFrame, *extra: str, hours: int = HOURS) -> DataFrame:
    """``df`` with ``log_equity``, ``equity`` and ``drawdown`` (share below the highest equity so far, which is 1 at least)."""
    if extra:
        so_far = series(*extra).rowsBetween(Window.unboundedPreceding, 0)
        made = df.withColumn("log_equity", F.sum(log_growth()).over(so_far)).withColumn("__top", F.max("log_equity").over(so_far))
    else:
        made = scanned(df, {"log_equity": Running("sum", log_growth()), "__top": Running("peak", log_growth())}, hours=hours)
    return made.withColumns({"equity": F.exp("log_equity"), "drawdown": 1 - F.exp(F.col("log_equity") - F.greatest(F.lit(0.0), F.col("__top")))}).drop("__top")


def metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Figures of each key from ``pnl``, ``pos`` and ``drawdown``; the Sharpe ratio is per bar."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(log_growth()).alias("log_total"), F.expm1(F.sum(log_growth())).alias("total"), F.avg("pnl").alias("mean"),
        ratio(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
        ratio(F.count_if(F.col("pnl") > 0), F.count_if(F.col("pos") != 0)).alias("hit_rate"), F.avg(F.abs("pos")).alias("exposure"),
    )


def crossover_grid(df: DataFrame, fast: Sequence[int], slow: Sequence[int], value: str = "close") -> DataFrame:
    """``df`` once for each pair fast < slow, with ``fast``, ``slow`` and their averages ``fast_avg`` and ``slow_avg``.

    Each look-back is computed once, however many pairs use it, and the pairs come out of an
    array on the bar: there is no join of bars with strategies. A small grid stays where the
    averages were computed, which saves a shuffle; a large one is dealt anew.
    """
    lengths = sorted({*fast, *slow})
    averaged = df.withColumns({f"__avg{n}": full(F.avg(value).over(last_rows(n)), n) for n in lengths})
    pairs = [F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"__avg{f}").alias("fast_avg"), F.col(f"__avg{s}").alias("slow_avg")) for f in fast for s in slow if f < s]
    if not pairs:
        raise ValueError("no fast look-back is shorter than a slow one")
    grid = averaged.select(*df.columns, F.explode(F.array(*pairs)).alias("__pair")).select(*df.columns, "__pair.*")
    return grid.repartition("sym", "fast", "slow") if len(pairs) >= DEAL_FROM else grid


def crossover_backtest(df: DataFrame, fast: Sequence[int], slow: Sequence[int], bps: float = 0.0) -> DataFrame:
    """Positions, profits and equity of every pair: in while the fast average is above the slow one."""
    keys = ("fast", "slow")
    above = F.col("fast_avg") > F.col("slow_avg")
    placed = with_position(crossover_grid(df, fast, slow), above, F.col("fast_avg") <= F.col("slow_avg"), *keys)
    return with_equity(with_profit(placed, bps, *keys), *keys)


def bracket_exits(df: DataFrame, entry: Column, stop: float, target: float, longest: int) -> DataFrame:
    """(sym, t_in, price_in, t_out, reason, ret) for each entry bar: the first later bar that touches a level.

    Levels are shares of the entry close. Within one bar the stop counts first, as the order of
    prices in it is unknown. After ``longest`` bars the close ends the trade (``time``); a trade
    that the data ends before is ``open``, at the last close seen. Up to ``FRAME`` bars on are looked at as a frame; what is
    farther is found by going down a tree of extremes (``first_touch``), so work doesn't grow with ``longest``.
    """
    price, low, high = F.col("close"), F.col("close") * (1 - stop), F.col("close") * (1 + target)
    if longest <= FRAME:
        later = F.collect_list(F.struct("bar_ts", "high", "low", "close")).over(series().rowsBetween(1, longest))
        seen = df.withColumn("__later", later).where(holds(entry))
        first = F.filter("__later", lambda bar: (bar["low"] <= low) | (bar["high"] >= high))
        found = seen.withColumn("__first", first)
        ending = F.when(F.size("__first") > 0, F.col("__first")[0]).when(F.size("__later") > 0, F.element_at("__later", -1))
        marked = found.select("*", ending.alias("__end"), (F.size("__first") > 0).alias("__touched"), (F.size("__later") == longest).alias("__whole"))
    else:
        marked = first_touch(df, entry, low, high, longest)
    bar = F.col("__end")
    reason = F.when(F.col("__touched"), F.when(bar["low"] <= low, "stop").otherwise("target")).when(F.col("__whole"), "time").otherwise("open")
    out = F.when(F.col("__reason") == "stop", low).when(F.col("__reason") == "target", high).otherwise(F.coalesce(bar["close"], price))
    return marked.withColumn("__reason", reason).select(
        "sym", F.col("bar_ts").alias("t_in"), price.alias("price_in"), bar["bar_ts"].alias("t_out"), F.col("__reason").alias("reason"), (ratio(out, price) - 1).alias("ret")
    )


def first_touch(df: DataFrame, entry: Column, low: Column, high: Column, longest: int) -> DataFrame:
    """The entry rows of ``df`` with ``__end``, the first of the next ``longest`` bars whose low is at most ``low`` or whose high is at least ``high``, else the last of them; ``__touched`` if one does, ``__whole`` if there are ``longest``.

    Rows are numbered, and a tree over a symbol's numbers has the lowest low and highest high of each node. An entry's bars are a few
    nodes a level; the first of these that touches is gone down a level at a time. So an entry meets some nodes for each level
    of the tree, and bars never meet entries but the one they end at.
    """
    rows = checkpointed(numbered(df.withColumns({"__low": low, "__high": high, "__entry": holds(entry)}), name="__row"))
    top = 0
    while 1 << (TREE_BITS * (top + 1)) <= longest:
        top += 1
    nodes, extremes = [], rows.select("sym", F.col("__row").alias("__node"), F.col("low").alias("__least"), F.col("high").alias("__most"))
    for level in range(top + 1):
        nodes.append(extremes.withColumn("__level", F.lit(level)))
        extremes = extremes.groupBy("sym", F.shiftright("__node", TREE_BITS).alias("__node")).agg(F.min("__least").alias("__least"), F.max("__most").alias("__most"))
    tree = checkpointed(reduce(DataFrame.unionByName, nodes)).withColumnsRenamed({"sym": "__sym"})
    last = rows.groupBy("sym").agg(F.max("__row").alias("__last")).withColumnsRenamed({"sym": "__sym"})
    asked = rows.where("__entry").select("sym", "__row", "__low", "__high").join(broadcast_up_to(checkpointed(last), BROADCAST_SYMBOLS), F.col("sym").eqNullSafe(F.col("__sym"))).drop("__sym")
    until = F.least(F.col("__row") + longest, F.col("__last"))
    asked = checkpointed(asked.withColumn("__until", until))
    piece = lambda level: F.transform(
        cells_of_range(F.col("__row") + 1, F.col("__until") + 1, level, top, TREE_BITS), lambda at: F.struct(F.lit(level).alias("__level"), at.alias("__node"))
    )
    begun = asked.withColumn("__piece", F.explode(F.concat(*[piece(level) for level in range(top + 1)]))).select("sym", "__row", "__low", "__high", "__piece.*")
    touches = (F.col("__least") <= F.col("__low")) | (F.col("__most") >= F.col("__high"))

    def touching(open_nodes: DataFrame) -> DataFrame:
        """Of each entry the first of its nodes that touches."""
        met_nodes = open_nodes.join(tree.withColumnsRenamed({"__level": "__l", "__node": "__n"}), F.col("sym").eqNullSafe(F.col("__sym")) & (F.col("__level") == F.col("__l")) & (F.col("__node") == F.col("__n")))
        start = F.expr(f"shiftleft(__node, {TREE_BITS} * __level)")
        return met_nodes.where(touches).groupBy("sym", "__row").agg(F.min_by(F.struct("__low", "__high", "__level", "__node"), start).alias("x")).select("sym", "__row", "x.*")

    found = checkpointed(touching(begun))
    for level in range(top, 0, -1):  # those that have come to this level go on to the next finer one
        children = F.explode(F.sequence(F.shiftleft("__node", TREE_BITS), F.shiftleft(F.col("__node") + 1, TREE_BITS) - 1))
        here = found.where(F.col("__level") == level).select("sym", "__row", "__low", "__high", F.lit(level - 1).alias("__level"), children.alias("__node"))
        found = checkpointed(found.where(F.col("__level") < level).unionByName(touching(here)))
    ends = asked.join(found.select(F.col("sym").alias("__sym"), F.col("__row").alias("__of"), F.col("__node").alias("__hit")), F.col("sym").eqNullSafe(F.col("__sym")) & (F.col("__row") == F.col("__of")), "left")
    ends = ends.select(
        F.col("sym").alias("__sym"), F.col("__row").alias("__of"), F.coalesce("__hit", "__until").alias("__at"), F.col("__hit").isNotNull().alias("__touched"),
        (F.col("__until") == F.col("__row") + longest).alias("__whole"),
    )
    bars = rows.select(F.col("sym").alias("__s"), F.col("__row").alias("__r"), F.struct("bar_ts", "high", "low", "close").alias("__end"))
    ended = ends.join(bars, F.col("__sym").eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__r"))).withColumn("__end", F.when(F.col("__at") > F.col("__of"), F.col("__end")))
    made = rows.where("__entry").join(ended, F.col("sym").eqNullSafe(F.col("__sym")) & (F.col("__row") == F.col("__of")))
    return made.select(*df.columns, "__end", "__touched", "__whole")


def trailing_exits(df: DataFrame, stop: float, by: Column) -> DataFrame:
    """(sym, part, t_in, t_out, stopped, ret): in at the first close of each part of a series, out at the first close that lies ``stop`` below the highest since, or at the last.

    The exit depends on the path, so each part goes through Python as a group; ``by`` must keep parts small (a day's bars).
    """

    def exits(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_ts")
        close = bars["close"].to_numpy()
        fallen = np.flatnonzero(close <= np.maximum.accumulate(close) * (1 - stop))
        at = int(fallen[0]) if len(fallen) else len(close) - 1
        made = {"sym": bars["sym"].iloc[0], "part": bars["part"].iloc[0], "t_in": bars["bar_ts"].iloc[0], "t_out": bars["bar_ts"].iloc[at], "stopped": len(fallen) > 0}
        return pd.DataFrame({name: [value] for name, value in made.items()} | {"ret": [close[at] / close[0] - 1 if close[0] else None]})

    kinds = {name: df.schema[name].dataType.simpleString() for name in ("sym", "bar_ts")}
    parts = df.select("sym", "bar_ts", "close", by.alias("part"))
    schema = f"sym {kinds['sym']}, part {parts.schema['part'].dataType.simpleString()}, t_in {kinds['bar_ts']}, t_out {kinds['bar_ts']}, stopped boolean, ret double"
    return parts.groupBy("sym", "part").applyInPandas(exits, schema)


def with_folds(df: DataFrame, folds: int, *extra: str) -> DataFrame:
    """``df`` with ``fold``: each series in time order, cut into equal parts from 1.

    A grid takes its folds from the bars that it is made of: that numbers them once.
    """
    return with_tiles(df, folds, "fold", ("sym", *extra))


def walk_forward(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(test_fold, keys, train_n, train_mean, test_n, test_mean): what was earned before each fold and in it.

    Profits are summed by fold first; training sums are running sums over those few rows.
    """
    parts = df.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("test_n"), F.sum("pnl").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    made = parts.withColumns({"train_n": F.sum("test_n").over(before), "__before": F.sum("__sum").over(before)}).where("fold > 1")
    return made.select(F.col("fold").alias("test_fold"), *keys, "train_n", ratio("__before", "train_n").alias("train_mean"), "test_n", ratio("__sum", "test_n").alias("test_mean"))


def mined(df: DataFrame, fast: Sequence[int], slow: Sequence[int], folds: int, best: int, bps: float = 0.0) -> DataFrame:
    """Walk-forward mining: before each fold the best pairs by what they earned so far, with what they earned in it, and how many were tried."""
    tested = walk_forward(crossover_backtest(with_folds(df, folds), fast, slow, bps), ["sym", "fast", "slow"])
    order = Window.partitionBy("sym", "test_fold").orderBy(F.desc_nulls_last("train_mean"), "fast", "slow")
    tried = F.count(F.lit(1)).over(Window.partitionBy("sym", "test_fold"))
    return tested.withColumns({"rank": F.row_number().over(order), "tried": tried}).where(F.col("rank") <= best)


def portfolio(df: DataFrame) -> DataFrame:
    """(bar_ts, n, pnl): equal weights across the symbols that have the bar."""
    return df.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("pnl"))


def excess(df: DataFrame, hours: int = HOURS) -> DataFrame:
    """``df`` with ``hold`` (the bar's return, held all the time) and ``excess`` over it."""
    hold = F.coalesce(ratio("close", "__close") - 1, F.lit(0.0))
    return scanned(df, previous={"__close": "close"}, hours=hours).withColumn("hold", hold).withColumn("excess", F.col("pnl") - F.col("hold")).drop("__close")
