"""Streams of ticks, bars over them, and state carried from batch to batch.

Watermarks need zoned timestamps, so a stream's ``ts`` is cast on the way in and bars' times are
cast back. In append mode a bar comes out when the watermark (the highest ``ts`` so far less
``delay``) has reached its end; later ticks for it are dropped.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import COLUMNS, _aggregates
from barloom.operators.indicators import ema_step, smoothed
from barloom.sources.shared import checkpointed, removed, shared_dir
from barloom.sources.tables import load


def tick_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Events as a stream of ticks."""
    reader = spark.readStream.schema(load(spark, sf_dir, "events").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(f"{sf_dir}/events.parquet*")  # a pattern may name a file as well as a folder
    return events.select(
        F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty")
    )


def stream_bars(ticks: DataFrame, every: str, delay: str) -> DataFrame:
    """Tumbling bars of a stream."""
    made = ticks.withWatermark("ts", delay).groupBy("sym", F.window("ts", every)).agg(*_aggregates())
    return made.select("sym", F.col("window.start").cast("timestamp_ntz").alias("bar_ts"), *COLUMNS)


def stream_session_bars(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    """A bar for each run of ticks without a gap; sessions end ``gap`` after their last tick."""
    made = ticks.withWatermark("ts", delay).groupBy("sym", F.session_window("ts", gap)).agg(*_aggregates())
    return made.select("sym", F.col("session_window.start").cast("timestamp_ntz").alias("bar_ts"), F.col("session_window.end").cast("timestamp_ntz").alias("end_ts"), *COLUMNS)


class Smoothed(NamedTuple):
    """A stream of ticks to be smoothed batch by batch; ``completed`` runs it."""

    ticks: DataFrame
    n: int


def stream_ema(ticks: DataFrame, n: int) -> Smoothed:
    """(sym, ts, seq, price, ema): each tick with the exponential average so far; the state is one number a symbol.

    A batch's ticks are smoothed in blocks by many tasks, however many a symbol has; batches must arrive in order. A null price keeps the
    average before it.
    """
    return Smoothed(ticks, n)


def _smoothed(stream: Smoothed, folder: str) -> DataFrame:
    """Each batch and its state in folders of its number: a batch that is run again writes the same again."""
    spark, kept = stream.ticks.sparkSession, ["sym", "ts", "seq", "price"]
    last: list[int] = []

    def smooth(batch: DataFrame, number: int) -> None:
        rows = batch.select(*kept, F.lit(1).alias("own"))
        if number:  # the averages so far come first, as ticks
            state = batch.sparkSession.read.parquet(f"{folder}/state/{number - 1}")
            rows = rows.unionByName(state.select("sym", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("seq"), F.col("ema").alias("price"), F.lit(0).alias("own")))
        smoothed(rows, [ema_step(stream.n, "price", "ema")], ("own", "ts", "seq"), "ts", hours=1).write.mode("overwrite").parquet(f"{folder}/out/{number}")
        made = batch.sparkSession.read.parquet(f"{folder}/out/{number}")
        ends = made.groupBy("sym").agg(F.max_by("ema", F.struct("own", "ts", "seq")).alias("ema"))
        ends.where(F.col("ema").isNotNull() & ~F.isnan("ema")).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        last[:] = [number]

    writer = stream.ticks.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(smooth).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], "sym string, ts timestamp, seq long, price double, ema double")
    return spark.read.parquet(*[f"{folder}/out/{number}" for number in range(last[0] + 1)]).where("own = 1").select(*kept, "ema")


def completed(stream: DataFrame | Smoothed, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input at hand, written to the shared folder and read back.

    In complete mode each batch holds the whole result, and the last batch's is returned. What the run needed
    is deleted then; the result itself is a checkpoint.
    """
    spark = (stream.ticks if isinstance(stream, Smoothed) else stream).sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    made = checkpointed(_smoothed(stream, folder) if isinstance(stream, Smoothed) else _run(stream, mode, folder))
    removed(spark, folder)
    return made


def _run(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        last[:] = [number]

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/{last[0]}") if last else spark.createDataFrame([], stream.schema)
