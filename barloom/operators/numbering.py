"""Row numbers and joins in time for keys of any size.

A symbol may hold a third of all ticks, so nothing here puts a whole symbol into one task: work
is done within (key, bucket of time), and what must cross buckets is carried over one row per
bucket, or, of windows with a bounded look-back, copied with the rows at the edge.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a part of a series.
PART = 100_000
#: A cell of time holds two to this power of the next finer ones.
BITS = 3


def bucket_of(ts: str | Column, every: str) -> Column:
    """The start of the epoch-aligned bucket that a time falls into."""
    return F.window(ts, every)["start"]


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "row", total: str | None = None) -> DataFrame:
    """``df`` with each row's number within ``keys`` from 1, and as ``total`` how many there are; ``bucket`` must not fall as ``order`` rises."""
    marked = df.withColumn("__bucket", bucket)
    sizes = marked.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = [] if total is None else [F.sum("__n").over(Window.partitionBy(*keys)).alias(total)]
    offsets = sizes.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *whole)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return marked.join(offsets, [*keys, "__bucket"]).withColumn(name, F.row_number().over(inside) + F.col("__before")).drop("__bucket", "__before")


def in_parts(bars: DataFrame, apply: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, part: int = PART, hours: int = 720) -> DataFrame:
    """``apply(bars)`` by many tasks a symbol, for columns that look at most ``back`` rows of their symbol back and ``ahead`` on.

    Windows by symbol put a whole series into one task. Here it is cut into parts of ``part`` rows, which also get the
    rows around them that theirs look at, and ``apply`` sees each part as a symbol of its own. It may add columns, but must
    keep rows and columns; what sums up a series from its start, or ranks all of it, is not for parts.
    """
    keyed = bars.withColumn("sym", F.struct("sym"))  # a null symbol is one like any other
    bucket = F.floor(F.unix_micros(F.col("bar_ts").cast("timestamp")) / F.lit(hours * 3_600_000_000))
    numbered = row_numbers(keyed, ["sym"], ["bar_ts"], F.coalesce(bucket, F.lit(-(1 << 62))), "__row").withColumn("__row", F.col("__row") - 1)
    place = lambda row: F.floor(row / F.lit(part))
    near = F.sequence(place(F.greatest(F.col("__row") - ahead, F.lit(0))), place(F.col("__row") + back))
    dealt = numbered.withColumn("__part", F.explode(near)).withColumn("sym", F.struct(F.col("sym.sym").alias("sym"), F.col("__part").alias("part"))).drop("__part")
    made = apply(dealt).where(F.col("sym.part") == place(F.col("__row")))
    return made.withColumn("sym", F.col("sym.sym")).drop("__row")


def as_of_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, every: str, on: str = "sym", strict: bool = False) -> DataFrame:
    """``left`` with the latest row of ``right`` at or before (``strict``: before) its time, as the struct ``as_of``.

    Right rows must be unique by (key, time). Rows without an earlier right row get null.
    """
    side = F.lit(1 if not strict else -1)
    found = right.select(
        F.col(on), bucket_of(right_ts, every).alias("__bucket"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"),
        F.struct(*right.columns).alias("__right"), F.lit(None).cast(left.schema).alias("__left"),
    )
    asked = left.select(
        F.col(on), bucket_of(left_ts, every).alias("__bucket"), F.col(left_ts).alias("__ts"), side.alias("__side"),
        F.lit(None).cast(right.schema).alias("__right"), F.struct(*left.columns).alias("__left"),
    )
    inside = Window.partitionBy(on, "__bucket").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = found.unionByName(asked).withColumn("__near", F.last("__right", ignorenulls=True).over(inside))
    ends = found.groupBy(on, "__bucket").agg(F.max_by("__right", "__ts").alias("__last"))
    asked_buckets = asked.select(on, "__bucket").distinct().withColumn("__last", F.lit(None).cast(right.schema))
    earlier = Window.partitionBy(on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = ends.unionByName(asked_buckets).groupBy(on, "__bucket").agg(F.first("__last", ignorenulls=True).alias("__last"))
    carried = per_bucket.select(on, "__bucket", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    joined = both.where("__left is not null").join(carried, [on, "__bucket"], "left")
    return joined.select("__left.*", F.coalesce("__near", "__carried").alias("as_of"))


def micros(spark: SparkSession, every: str) -> int | None:
    """The length of an interval in microseconds, or null if it has none (months)."""
    ends = [F.lit(start) + F.expr(f"INTERVAL {every}") - F.lit(start) for start in (dt.datetime(1970, 1, 1), dt.datetime(1970, 2, 1))]
    length, other = (int(length.total_seconds() * 1_000_000) for length in spark.range(1).select(ends[0].alias("a"), ends[1].alias("b")).first())
    return length if length == other else None


def _numbers(start: Column, end: Column) -> Column:
    """The whole numbers from ``start`` up to ``end``, which isn't one of them."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def cells_of_range(first: Column, end: Column, level: int, top: int, bits: int = BITS) -> Column:
    """The cells of a level that lie in a range of finest cells (``end`` not included), but in no cell of the next level that does; a cell holds 2 ** ``bits`` finer ones."""
    inside = lambda level: (-F.shiftright(-first, bits * level), F.shiftright(end, bits * level))
    low, high = inside(level)
    if level == top:
        return _numbers(low, high)
    above, until = (F.shiftleft(x, bits) for x in inside(level + 1))
    return F.when(above < until, F.concat(_numbers(low, F.least(high, above)), _numbers(F.greatest(low, until), high))).otherwise(_numbers(low, high))


def range_join(points: DataFrame, ranges: DataFrame, ts: str, start: str, end: str, every: str, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and ranges with start <= ts < end, by equi-joins over a tree of cells of time.

    Cells of length ``every`` are the leaves, and each cell of a level holds 2 ** ``BITS`` of the level below. A range is cut into
    the largest cells that make it up, a few a level, so what a range takes grows with the logarithm of its
    length; a point asks for the cells that hold it, one a level. A pair meets in one cell alone.
    """
    length = micros(points.sparkSession, every)
    if length is None:
        raise ValueError("cells need a fixed length")
    cell = lambda ts: F.floor(F.unix_micros(ts.cast("timestamp")) / length)
    sound = ranges.where(F.col(start) < F.col(end)).withColumns({"__first": cell(F.col(start)), "__end": cell(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")) + 1})
    longest, top = sound.agg(F.max(F.col("__end") - F.col("__first"))).first()[0] or 1, 0
    while 1 << (BITS * (top + 1)) <= longest:
        top += 1
    cells = lambda level: F.transform(cells_of_range(F.col("__first"), F.col("__end"), level, top), lambda at: F.struct(F.lit(level).alias("__level"), at.alias("__cell")))
    right = sound.withColumn("__piece", F.explode(F.concat(*[cells(level) for level in range(top + 1)]))).select(*ranges.columns, "__piece.*")
    up = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda level: F.struct(level.alias("__level"), level.alias("__up")))
    left = points.withColumn("__fine", cell(F.col(ts))).withColumn("__at", F.explode(up))
    left = left.withColumns({"__level": F.col("__at.__level"), "__cell": F.expr(f"shiftright(__fine, {BITS} * __at.__up)")}).drop("__fine", "__at")
    return left.join(right, [*on, "__level", "__cell"]).where((F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end))).drop("__level", "__cell")
