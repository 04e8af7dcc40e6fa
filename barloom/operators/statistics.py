"""Exact percentiles of keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.joins import broadcast_up_to
from barloom.sources.shared import checkpointed

#: So many keys are broadcast at most, with RANGES numbers each.
BROADCAST_KEYS = 10_000
#: Ranges of values that a key's rows are cut into.
RANGES = 128


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each of ``shares``): percentiles with interpolation, as by sorting all of a key's values.

    Equal values are counted first. A sketch cuts each key's values into ranges; running counts of the ranges tell
    which hold the ranks in question, and only those ranges' values are put in order. Nulls don't count.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    counts = checkpointed(known.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")))
    cuts = counts.groupBy("key").agg(F.approx_percentile("value", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"), F.sum("n").alias("all"))
    cuts = broadcast_up_to(checkpointed(cuts.withColumnRenamed("key", "key_of")), BROADCAST_KEYS)
    placed = counts.join(cuts, F.col("key").eqNullSafe(F.col("key_of"))).select("key", "value", "n", "all", F.size(F.filter("cuts", lambda cut: cut < F.col("value"))).alias("range"))
    placed = checkpointed(placed)
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("key", "range").agg(F.sum("n").alias("here"), F.max("all").alias("all"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    rank = {name: (F.col("all") - 1) * share for name, share in shares.items()}
    ends = [end(at) for at in rank.values() for end in (F.floor, F.ceil)]
    wanted = F.exists(F.array(*ends), lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("here")))
    asked = ranges.where(wanted).select(F.col("key").alias("key_of"), F.col("range").alias("range_of"), "before")
    inside = Window.partitionBy("key", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(asked, F.col("key").eqNullSafe(F.col("key_of")) & (F.col("range") == F.col("range_of")))
    until = near.withColumn("until", F.sum("n").over(inside) + F.col("before"))
    holds = lambda at: (F.col("until") - F.col("n") <= at) & (at < F.col("until"))
    value_at = lambda at: F.max(F.when(holds(at), F.col("value")))
    found = [(value_at(F.floor(at)) + (value_at(F.ceil(at)) - value_at(F.floor(at))) * F.max(at - F.floor(at))).alias(name) for name, at in rank.items()]
    return until.groupBy("key").agg(*found).withColumnRenamed("key", key)
