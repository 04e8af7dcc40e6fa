"""Bars (sym, bar_ts, open, high, low, close, volume, ticks) from ticks and from finer bars.

Bars are left-closed and named by their start. Each is one aggregation with partial sums before
the shuffle, so a symbol with very many ticks costs as many rows as it has bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import ratio, series
from barloom.operators.numbering import bucket_of, micros, row_numbers
from barloom.operators.scans import HOURS, Running, scanned

#: Steps of a block of a calendar.
CALENDAR_BLOCK = 4096
COLUMNS = ("open", "high", "low", "close", "volume", "ticks")


def _aggregates() -> list[Column]:
    order = F.struct("ts", "seq")
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("ticks"),
    ]


def _merged(order: str) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks"),
    ]


def bars(ticks: DataFrame, every: str, slide: str | None = None) -> DataFrame:
    """Tumbling bars of a fixed length (aligned to the epoch), or overlapping ones every ``slide``."""
    return ticks.groupBy("sym", F.window("ts", every, slide)["start"].alias("bar_ts")).agg(*_aggregates())


def calendar_bars(ticks: DataFrame, unit: str) -> DataFrame:
    """Bars of calendar units: day, week, month, quarter, year."""
    return ticks.groupBy("sym", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar_ts")).agg(*_aggregates())


def resample(finer: DataFrame, every: str) -> DataFrame:
    """Coarser bars from bars."""
    return finer.withColumn("__start", F.window("bar_ts", every)["start"]).groupBy("sym", F.col("__start").alias("bar_ts")).agg(*_merged("bar_ts"))


def session_bars(ticks: DataFrame, gap: str) -> DataFrame:
    """A bar for each run of ticks that are at most ``gap`` apart, with its start, end and length.

    Ticks of one bucket of that width are always in one session, so sessions are found on one row
    per bucket.
    """
    cells = ticks.groupBy("sym", bucket_of("ts", gap).alias("__bucket")).agg(*_aggregates(), F.min("ts").alias("bar_ts"), F.max("ts").alias("end_ts"))
    breaks = F.col("bar_ts") > F.lag("end_ts").over(series()) + F.expr(f"INTERVAL {gap}")
    numbered = cells.withColumn("session", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(series()))
    merged = numbered.groupBy("sym", "session").agg(*_merged("bar_ts"), F.min("bar_ts").alias("__start"), F.max("end_ts").alias("end_ts"))
    return merged.select("sym", F.col("__start").alias("bar_ts"), "end_ts", *COLUMNS)


def count_bars(ticks: DataFrame, n: int, bucket: str = "1 day") -> DataFrame:
    """A bar for every n ticks of a symbol, numbered from 0."""
    numbered = row_numbers(ticks, ["sym"], ["ts", "seq"], bucket_of("ts", bucket))
    return numbered.groupBy("sym", F.floor((F.col("row") - 1) / n).alias("bar")).agg(F.min("ts").alias("bar_ts"), *_aggregates())


def volume_bars(ticks: DataFrame, size: float, bucket: str = "1 day") -> DataFrame:
    """A bar for every ``size`` of traded quantity; the tick that fills a bar belongs to it."""
    marked = ticks.withColumn("__bucket", bucket_of("ts", bucket))
    before = Window.partitionBy("sym").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("sym", "__bucket").agg(F.sum("qty").alias("__qty")).select("sym", "__bucket", F.coalesce(F.sum("__qty").over(before), F.lit(0.0)).alias("__before"))
    inside = Window.partitionBy("sym", "__bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.sum("qty").over(inside), F.lit(0.0)) + F.col("__before")
    placed = marked.join(offsets, ["sym", "__bucket"]).withColumn("bar", F.floor(reached / size))
    return placed.groupBy("sym", "bar").agg(F.min("ts").alias("bar_ts"), *_aggregates())


def calendar(found: DataFrame, every: str, block: int = CALENDAR_BLOCK) -> DataFrame:
    """(sym, bar_ts): every step from each symbol's first bar to its last.

    Steps of a fixed length come out of numbered blocks of ``block`` of them: the numbers of blocks, and before these of blocks
    of blocks, are dealt out first, so no row holds more than ``block`` entries and a long range is many tasks' work.
    Steps of months differ in length and are few: they come out of one array.
    """
    kind, bar = found.schema["bar_ts"].dataType.simpleString(), F.col("bar_ts")
    known = found.where(bar.isNotNull())
    length = micros(found.sparkSession, every)
    if length is None:
        return known.groupBy("sym").agg(F.min(bar).alias("first"), F.max(bar).alias("last")).select("sym", F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {every}"))).alias("bar_ts"))
    first, last = F.unix_micros(F.min(bar.cast("timestamp"))), F.unix_micros(F.max(bar.cast("timestamp")))
    counted = known.groupBy("sym").agg(first.alias("first"), F.floor((last - first) / length).alias("most")).withColumn("step", F.lit(0).cast("long"))
    width, longest = block, known.agg(F.floor((last - first) / length)).first()[0] or 0
    while width <= longest:
        width *= block
    while width > 1:  # from the coarsest blocks to single steps
        width //= block
        more = F.least(F.lit(block - 1), F.floor((F.col("most") - F.col("step")) / width))
        counted = counted.withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), more))).withColumn("step", F.col("step") + F.col("more") * width)
        if width > 1:
            counted = counted.repartition("sym", "step")
    return counted.select("sym", F.timestamp_micros(F.col("first") + F.col("step") * length).cast(kind).alias("bar_ts"))


def fill_calendar(found: DataFrame, every: str) -> DataFrame:
    """Each symbol's bars on every step from its first to its last; missing bars are null with volume 0."""
    filled = calendar(found, every).withColumnsRenamed({"sym": "__sym", "bar_ts": "__ts"}).join(found, F.col("__sym").eqNullSafe(F.col("sym")) & (F.col("__ts") == F.col("bar_ts")), "left")
    made = filled.withColumns({"sym": F.col("__sym"), "bar_ts": F.col("__ts"), "volume": F.coalesce("volume", F.lit(0.0)), "ticks": F.coalesce("ticks", F.lit(0))})
    return made.select(found.columns)


def forward_fill(df: DataFrame, *columns: str, hours: int = HOURS) -> DataFrame:
    """The last known value for each null, worked out in buckets of ``hours``."""
    return scanned(df, {name: Running("last", F.col(name)) for name in columns}, hours=hours)


def vwap(found: DataFrame, *by: str) -> DataFrame:
    """The close weighted by volume, for each symbol and ``by``."""
    return found.groupBy("sym", *by).agg(ratio(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap"), F.sum("volume").alias("volume"))


def invalid(found: DataFrame) -> DataFrame:
    """Bars that can't be: a price outside low..high, a null price, or a negative volume."""
    inside = F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high")) & (F.col("volume") >= 0)
    return found.where(~F.coalesce(inside, F.lit(False)))
