"""Strategies out of mined sets of conditions: enumerated, scored on the earlier part of each series, and then on the later.

A strategy enters where one set of conditions holds and leaves where another does. Sets come from the earlier part alone.
Thousands of strategies are worked out at once and bars never meet them in a join: bars go through in blocks, as a
matrix of bits by bar and condition; a product of matrices tells which sets hold, and a running maximum where each strategy's last
signal was. What a block does to a position is one of the maps of two states: it keeps it, or sets it to in or
out. So a block gives, for both positions it may be entered with, the position it is left with and what was earned meanwhile;
blocks compose in any grouping. The blocks of a bucket of time make one row, and only these rows are folded in
order, symbol by symbol.

A position acts on the bar after its signal. That bar's profit is counted at the signal's bar, if both lie in one
fold and the return is known: so nothing that the earlier fold counts looks into the later one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from barloom.functions.columns import ratio, series
from barloom.operators import rules
from barloom.operators.conditions import holds
from barloom.operators.numbering import in_parts
from barloom.operators.scans import HOURS, bucket
from barloom.operators.strategies import LEAST_LEFT
from barloom.sources.shared import checkpointed

#: More strategies than this are refused: the floor of the sets has to be raised.
MOST = 20_000
#: Bars of a block, and strategies that a block is worked out for at once.
BLOCK, AT_ONCE = 512, 1024
#: Digits of the mean that strategies are ranked by.
RANKED_DIGITS = 9
#: Figures that add up, and those of the running sum of log growth: its sum, highest, lowest and largest fall.
ADDED, PATH = ("exposure", "entries", "wins", "total", "squares"), ("growth", "top", "low", "fall")
FIGURES = (*ADDED, *PATH)

Batches = Iterator[pa.RecordBatch]


class Strategies(NamedTuple):
    """Sets as a matrix by set and condition, and each strategy's places of its entry and exit among them."""

    names: tuple[str, ...]
    sets: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, int], ...]

    def matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        members = np.array([[name in items for name in self.names] for items in self.sets], np.float32).reshape(len(self.sets), len(self.names))
        places = np.array(self.pairs, np.int64).reshape(-1, 2)
        return members, places[:, 0], places[:, 1]


def strategies_of(names: Sequence[str], sets: Sequence[Sequence[str]]) -> Strategies:
    """Every pair of sets but those whose exit holds wherever their entry does, as leaving wins then."""
    ordered = sorted(tuple(sorted(items)) for items in sets)
    pairs = tuple((e, x) for (e, entry), (x, leave) in itertools.product(enumerate(ordered), repeat=2) if not {*leave} <= {*entry})
    if len(pairs) > MOST:
        raise ValueError(f"{len(pairs)} strategies out of {len(ordered)} sets are more than {MOST}: raise the least number of bars")
    return Strategies(tuple(names), tuple(ordered), pairs)


class Outcome(NamedTuple):
    """What a run of bars comes to, by the position it is entered with: (2, strategies) positions it is left with, and (2, folds, figures, strategies)."""

    left: np.ndarray
    figures: np.ndarray

    def then(self, later: Outcome) -> Outcome:
        pick = self.left[:, None, None, :] == 1
        after = np.where(pick, later.figures[1], later.figures[0])
        return Outcome(np.where(self.left == 1, later.left[1], later.left[0]), joined(self.figures, after))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Figures of one run after another (the figures are the last axis but one)."""
    out, n = a + b, len(ADDED)
    (growth, top, low, fall), (_, later_top, later_low, later_fall) = (tuple(x[..., n + k, :] for k in range(4)) for x in (a, b))
    out[..., n + 1, :] = np.maximum(top, growth + later_top)
    out[..., n + 2, :] = np.minimum(low, growth + later_low)
    out[..., n + 3, :] = np.maximum(np.maximum(fall, later_fall), top - growth - later_low)
    return out


def nothing(folds: int, strategies: int) -> Outcome:
    return Outcome(np.tile(np.arange(2, dtype=np.int8)[:, None], (1, strategies)), np.zeros((2, folds, len(FIGURES), strategies)))


def block_outcome(held: np.ndarray, enter: np.ndarray, leave: np.ndarray, fwd: np.ndarray, fold: np.ndarray, folds: int, fee: float) -> Outcome:
    """The outcome of some bars in order: ``held`` by bar and set, ``fold`` from 1, 0 where a bar doesn't count."""
    goes = held[:, leave]
    comes = held[:, enter] & ~goes
    at = np.maximum.accumulate(np.where(comes | goes, np.arange(len(held), dtype=np.int32)[:, None], -1), axis=0)
    known, said = at >= 0, np.take_along_axis(comes, np.maximum(at, 0), axis=0)
    left, figures = np.empty((2, len(enter)), np.int8), np.zeros((2, folds, len(FIGURES), len(enter)))
    for entered in range(2):
        wanted = np.where(known, said, bool(entered))
        before = np.vstack([np.full((1, len(enter)), bool(entered)), wanted[:-1]])
        left[entered] = wanted[-1]
        profit = wanted * fwd[:, None] - (wanted != before) * fee
        for number in range(folds):
            rows = fold == number + 1
            if not rows.any():
                continue
            inside, earned = wanted[rows], profit[rows]
            path = np.cumsum(np.log(np.maximum(1 + earned, LEAST_LEFT)), axis=0)
            top = np.maximum(0, np.maximum.accumulate(path, axis=0))
            figures[entered, number] = [
                inside.sum(axis=0), (inside & ~before[rows]).sum(axis=0), (earned > 0).sum(axis=0), earned.sum(axis=0), (earned * earned).sum(axis=0),
                path[-1], top[-1], np.minimum(0, path.min(axis=0)), (top - path).max(axis=0),
            ]
    return Outcome(left, figures)


BUCKETS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bars", T.ArrayType(T.LongType())), T.StructField("left", T.BinaryType()), T.StructField("figures", T.BinaryType())])


def _outcomes(found: Strategies, folds: int, fee: float, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Bars in order of (sym, bucket, time) as one row for each bucket of a symbol."""
    members, enter, leave = found.matrices()
    sizes, n = members.sum(axis=1), len(enter)

    def work(batches: Batches) -> Batches:
        key, outcome, bars = object(), None, None

        def done() -> pa.RecordBatch:
            row = (*key, bars.tolist(), outcome.left.tobytes(), outcome.figures.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([value], kind.type) for value, kind in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
            for start, end in itertools.pairwise(edges):
                if outcome is None or keys[start] != key:
                    if outcome is not None:
                        yield done()
                    key, outcome, bars = keys[start], nothing(folds, n), np.zeros(folds, np.int64)
                for at in range(start, end, BLOCK):
                    part = batch.slice(at, min(BLOCK, end - at))
                    fold, fwd = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                    bits = np.stack([column.to_numpy(zero_copy_only=False) for column in part.columns[4:]], axis=1).astype(np.float32)
                    held = bits @ members.T == sizes
                    bars += np.bincount(fold, minlength=folds + 1)[1:]
                    pieces = [block_outcome(held, enter[k : k + AT_ONCE], leave[k : k + AT_ONCE], fwd, fold, folds, fee) for k in range(0, n, AT_ONCE)]
                    outcome = outcome.then(Outcome(np.concatenate([p.left for p in pieces], axis=1), np.concatenate([p.figures for p in pieces], axis=3)))
        if outcome is not None:
            yield done()

    return work


TOTALS = "strategy int, fold int, bars long, " + ", ".join(f"{name} double" for name in (*ADDED, "growth", "fall"))


def _folded(folds: int, n: int, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Buckets of whole symbols in order as the figures of a partition's symbols together; each symbol starts out of the market."""

    def work(batches: Batches) -> Batches:
        key, state, own = object(), None, None
        bars, total, falls = np.zeros(folds, np.int64), np.zeros((folds, len(FIGURES), n)), np.zeros((folds, n))

        def closed() -> None:
            nonlocal total, falls
            if own is not None:
                total, falls = total + own, np.maximum(falls, own[:, -1])

        for batch in batches:
            for sym, _, counted, left, figures in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own is None or sym != key:
                    closed()
                    key, state, own = sym, np.zeros(n, np.int8), np.zeros((folds, len(FIGURES), n))
                moves, both = np.frombuffer(left, np.int8).reshape(2, n), np.frombuffer(figures).reshape(2, folds, len(FIGURES), n)
                own = joined(own, np.where(state == 1, both[1], both[0]))
                state = np.where(state == 1, moves[1], moves[0])
                bars += np.array(counted)
        closed()
        if own is None:
            return
        for fold in range(folds):
            columns = [np.arange(n, dtype=np.int32), np.full(n, fold + 1, np.int32), np.full(n, bars[fold]), *total[fold, : len(ADDED) + 1], falls[fold]]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(columns, schema, strict=True)], schema=schema)

    return work


def scored(df: DataFrame, found: Strategies, folds: int, bps: float = 0.0, hours: int = HOURS) -> DataFrame:
    """(strategy, fold, bars, figures) of every strategy over ``df`` (sym, bar_ts, conditions, ``fold`` from 1, ``fwd`` of one bar)."""
    counted = lambda df: df.withColumn("__counted", (F.lead("fold").over(series()) == F.col("fold")) & F.col("fwd").isNotNull() & ~F.isnan("fwd"))
    marked = in_parts(df.select("sym", "bar_ts", "fold", "fwd", *found.names), counted, back=0, ahead=1)
    number = F.when(holds(F.col("__counted")), F.col("fold")).otherwise(0).cast("int")
    rows = marked.select(
        "sym", bucket("bar_ts", hours).alias("bucket"), number.alias("fold"), F.when(number > 0, F.col("fwd")).otherwise(0.0).alias("fwd"), *[holds(F.col(name)).alias(name) for name in found.names], "bar_ts"
    ).repartition("sym", "bucket").sortWithinPartitions("sym", "bucket", "bar_ts").drop("bar_ts")
    kinds = T.StructType([df.schema["sym"], *BUCKETS])
    buckets = rows.mapInArrow(_outcomes(found, folds, bps / 10_000, to_arrow_schema(kinds)), kinds)
    totals = T.StructType.fromDDL(TOTALS)
    parts = buckets.repartition("sym").sortWithinPartitions("sym", "bucket").mapInArrow(_folded(folds, len(found.pairs), to_arrow_schema(totals)), totals)
    sums = [F.sum(name).alias(name) for name in ("bars", *ADDED, "growth")]
    return parts.groupBy("strategy", "fold").agg(*sums, F.max("fall").alias("fall"))


def mined(df: DataFrame, names: Sequence[str], longest: int, least: int, bps: float = 0.0, hours: int = HOURS) -> DataFrame:
    """The mining loop from conditions to strategies: sets that hold on ``least`` counted bars of the earlier fold or more, every pair of them as entry and exit, ranked by what they earned there, with what they earned in the later fold.

    (entry, exit, rank, tried, and for train and test each: bars, entries, total, mean, sharpe, exposure, hit_rate, drawdown).
    ``df`` has the conditions ``names``, ``fold`` (1 and 2) and ``fwd``, the return of the next bar. Means are per bar and over all symbols;
    the drawdown is the worst of any symbol. Strategies are ranked by the earlier mean, to nine digits, then by name.
    """
    df = checkpointed(df.select("sym", "bar_ts", "fold", "fwd", *names))  # the sets, then the strategies read it
    early = rules.purged(df, 1).where((F.col("fold") == 1) & F.col("fwd").isNotNull())
    frequent = rules.itemsets(early, names, longest, least).select("items").limit(MOST + 2).collect()
    found = strategies_of(names, [row["items"] for row in frequent])
    spark = df.sparkSession
    called = [(k, "+".join(found.sets[e]), "+".join(found.sets[x])) for k, (e, x) in enumerate(found.pairs)]
    known = spark.createDataFrame(called, "strategy int, entry string, exit string")
    if not called:
        figures = spark.createDataFrame([], TOTALS)
    else:
        figures = scored(df, found, 2, bps, hours)
    wide = figures.groupBy("strategy")
    parts = []
    for part, number in (("train", 1), ("test", 2)):
        of = lambda name: F.max(F.when(F.col("fold") == number, F.col(name)))  # noqa: B023, E731
        n, total = of("bars"), of("total")
        spread = F.sqrt(F.greatest(F.lit(0.0), ratio(of("squares") - total * ratio(total, n), n - 1)))
        made = {
            "bars": n, "entries": of("entries").cast("long"), "total": total, "mean": ratio(total, n), "sharpe": ratio(ratio(total, n), spread), "exposure": ratio(of("exposure"), n),
            "hit_rate": ratio(of("wins"), of("exposure")), "drawdown": 1 - F.exp(-of("fall")),
        }
        parts += [column.alias(f"{part}_{name}") for name, column in made.items()]
    scores = wide.agg(*parts).join(F.broadcast(known), "strategy").drop("strategy")  # at most MOST rows
    order = Window.orderBy(F.desc_nulls_last(F.round("train_mean", RANKED_DIGITS)), "entry", "exit")
    return scores.withColumns({"rank": F.row_number().over(order).cast("long"), "tried": F.lit(len(called)).cast("long")})
