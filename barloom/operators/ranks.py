"""Ranks and n-tiles within series of any length.

A window over a whole symbol puts all its rows in order in one task. Here equal values are counted first, a sketch cuts each
key's values into ranges that hold about as many different values each, running counts over the ranges tell what lies before
each, and only within a range are values put in order. A value that many rows share is one row of counts by then;
rows meet their value's figures in a join, which Spark splits where a value is common.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.joins import broadcast_up_to
from barloom.operators.numbering import row_numbers
from barloom.operators.scans import bucket, met
from barloom.sources.shared import checkpointed

#: Ranges that a key's different values are cut into, and so many keys' cuts are broadcast at most.
RANGES, BROADCAST_KEYS = 128, 10_000


def cut_into_ranges(values: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``values`` (keys, value, ...) with ``range``: which of its key's ranges a value lies in; nulls come first."""
    cuts = values.groupBy(*keys).agg(F.approx_percentile(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts"))
    cuts = broadcast_up_to(checkpointed(cuts.withColumnsRenamed({key: f"{key}__of" for key in keys})), BROADCAST_KEYS)
    place = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("cuts", lambda cut: cut < F.col(value))))
    return values.join(cuts, met(keys, "__of")).select(*values.columns, place.alias("range"))


def ranked(df: DataFrame, value: str, names: dict[str, str], keys: Sequence[str] = ("sym",)) -> DataFrame:
    """``df`` with columns ``names`` (name: rank, dense_rank, percent_rank or cume_dist) of a numeric column within ``keys``, as the window functions give; nulls rank first."""
    counts = checkpointed(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    placed = checkpointed(cut_into_ranges(counts, keys, value))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranges = placed.groupBy(*keys, "range").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    ranges = ranges.select(*keys, "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("values").over(before), F.lit(0)).alias("values_before"), F.sum("rows").over(whole).alias("all"))
    ranges = broadcast_up_to(checkpointed(ranges.withColumnsRenamed({name: f"{name}__of" for name in (*keys, "range")})), BROADCAST_KEYS * RANGES)
    inside = Window.partitionBy(*keys, "range").orderBy(value)
    until = F.col("rows_before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rank = until - F.col("n") + 1
    made = {
        "rank": rank, "dense_rank": F.col("values_before") + F.row_number().over(inside), "cume_dist": until / F.col("all"),
        "percent_rank": F.when(F.col("all") > 1, (rank - 1) / (F.col("all") - 1)).otherwise(0.0),
    }
    figures = placed.join(ranges, met([*keys, "range"], "__of")).select(*[F.col(name).alias(f"{name}__of") for name in (*keys, value)], *[made[kind].alias(name) for name, kind in names.items()])
    return df.join(figures, met([*keys, value], "__of")).select(*[name for name in df.columns if name not in names], *names)


def numbered(df: DataFrame, keys: Sequence[str] = ("sym",), ts: str = "bar_ts", name: str = "row", total: str | None = None) -> DataFrame:
    """``df`` with each row's number in time within ``keys``, from 1, and as ``total`` how many there are, worked out in buckets of time; null keys are keys like any other."""
    whole = df.withColumn("__keys", F.struct(*keys))
    return row_numbers(whole, ["__keys"], [ts], bucket(ts), name, total).drop("__keys")


def tile(row: Column, rows: Column, tiles: int) -> Column:
    """The tile of a row's number among ``rows``, as ``ntile`` gives: the first ones are one row longer where they don't divide evenly."""
    size, longer = F.floor(rows / tiles), rows % tiles
    edge = longer * (size + 1)
    late = longer + F.floor((row - 1 - edge) / F.when(size > 0, size)) + 1
    return F.when(row <= edge, F.floor((row - 1) / (size + 1)) + 1).otherwise(late).cast("int")


def with_tiles(df: DataFrame, tiles: int, name: str = "tile", keys: Sequence[str] = ("sym",), ts: str = "bar_ts") -> DataFrame:
    """``df`` with ``name``: each series in time, cut into equal parts from 1."""
    made = numbered(df, keys, ts, "__row", "__all")
    return made.withColumn(name, tile(F.col("__row"), F.col("__all"), tiles)).select(*[column for column in df.columns if column != name], name)


def with_first_values(df: DataFrame, value: str, places: dict[str, int], keys: Sequence[str] = ("sym",), ts: str = "bar_ts") -> DataFrame:
    """``df`` with the value of the first, second, ... row of each series (name: place) from that row on, null before it."""
    rows = numbered(df, keys, ts, "__row")
    most = max(places.values())
    picked = [F.max(F.when(F.col("__row") == place, F.struct(F.col(value).alias("x"))))["x"].alias(name) for name, place in places.items()]
    firsts = rows.where(F.col("__row") <= most).groupBy(*keys).agg(*picked).withColumnsRenamed({key: f"{key}__of" for key in keys} | {name: f"__{name}" for name in places})
    made = rows.join(broadcast_up_to(checkpointed(firsts), BROADCAST_KEYS), met(keys, "__of"))
    return made.withColumns({name: F.when(F.col("__row") >= place, F.col(f"__{name}")) for name, place in places.items()}).select(*[name for name in df.columns if name not in places], *places)
