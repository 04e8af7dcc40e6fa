"""Reading and writing tables, and ticks from the tables at hand.

A tick is (sym, ts, seq, price, qty); ``seq`` breaks ties of ``ts``, without which a bar's open
and close would not be determined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Writes Parquet; rows of one partition value are brought together first, in parts that Spark may split if they are large."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: a symbol for each event type."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("sym"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty")
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks: a symbol for each brand; ``seq`` is a struct, as no single column tells line items apart."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sym"))
    lines = load(spark, sf_dir, "lineitem")
    return lines.join(parts, "l_partkey").select(
        "sym", F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
    )
