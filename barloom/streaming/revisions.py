"""Bars of a stream that late ticks correct.

A batch's ticks become parts of bars. Bars that may still change are the state: a part is merged with its bar there, and
every bar that a batch touches comes out once more, under the batch's number as its version. A bar is closed ``live``
behind its end, by the highest time that earlier batches brought; later ticks for it are dropped. Each batch writes its bars
and its state to folders of its number, out of the state of the number before, so a batch that is run twice writes the
same twice, and the latest version of each bar is what all ticks come to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import COLUMNS
from barloom.sources.shared import checkpointed, removed, shared_dir

KEY = ("sym", "bar_ts")


def _parts(ticks: DataFrame, every: str) -> DataFrame:
    """Ticks as parts of bars: with the first and last tick instead of open and close, so that parts merge in any order."""
    tick = F.struct("ts", "seq", "price")
    return ticks.groupBy("sym", F.window("ts", every)["start"].alias("bar_ts")).agg(
        F.min(tick).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(tick).alias("last"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("ticks")
    )


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume"),
        F.sum("ticks").alias("ticks"), F.max("version").alias("version"),
    )


def _bars(parts: DataFrame) -> DataFrame:
    made = {"open": F.col("first")["price"], "close": F.col("last")["price"]}
    return parts.withColumns(made).select("sym", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), *COLUMNS, "version")


def revise(every: str, live: str, folder: str) -> Callable[[DataFrame, int], None]:
    """What to do with a batch and its number, under ``folder``."""

    def open_at(time: Column) -> Column:
        return F.col("bar_ts") + F.expr(f"INTERVAL {every}") + F.expr(f"INTERVAL {live}") > time

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = checkpointed(_parts(batch, every).withColumn("version", F.lit(number).cast("long")))
        newest = parts.agg(F.max("last.ts")).first()[0]
        seen = None
        if number:
            seen = spark.read.parquet(f"{folder}/seen/{number - 1}").first()[0]
            if seen is not None:
                parts = parts.where(open_at(F.lit(seen)))
            parts = parts.unionByName(spark.read.parquet(f"{folder}/state/{number - 1}"))
        bars = checkpointed(_merged(parts))
        bars.where(F.col("version") == number).write.mode("overwrite").parquet(f"{folder}/out/{number}")
        highest = max((time for time in (seen, newest) if time is not None), default=None)
        (bars if highest is None else bars.where(open_at(F.lit(highest)))).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        spark.createDataFrame([(highest,)], "at timestamp").write.mode("overwrite").parquet(f"{folder}/seen/{number}")

    return work


def latest(folder: str, like: DataFrame, numbers: int) -> DataFrame:
    """Each bar's latest version in the folders of so many batches."""
    spark = like.sparkSession
    if not numbers:
        return spark.createDataFrame([], "sym string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, ticks long, version long")
    out = spark.read.parquet(*[f"{folder}/out/{number}" for number in range(numbers)])
    whole = F.max_by(F.struct(*[name for name in out.columns if name not in KEY]), "version")
    return _bars(out.groupBy(*KEY).agg(whole.alias("x")).select(*KEY, "x.*"))


def revised_bars(ticks: DataFrame, every: str, live: str) -> DataFrame:
    """Bars of a stream with their ``version`` when all the input at hand has been read; what the run needed is deleted then."""
    spark = ticks.sparkSession
    folder, last = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", []
    work = revise(every, live, folder)

    def each(batch: DataFrame, number: int) -> None:
        work(batch, number)
        last[:] = [number]

    ticks.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    made = checkpointed(latest(folder, ticks, last[0] + 1 if last else 0))
    removed(spark, folder)
    return made
