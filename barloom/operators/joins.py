"""Joins that broadcast a side only behind a check of its size, and joins with keys that hold much of a side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many rows are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Items that a sketch follows for each heavy key that there may be.
SKETCH_ITEMS = 16


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; a plain join side beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup_join(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with a table that is looked up: without a shuffle of ``df`` while that is small, by key beyond that (Spark splits skewed keys then)."""
    return df.join(broadcast_up_to(other, rows), list(on), how)


def heavy_keys(df: DataFrame, on: Sequence[str], share: float) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows, by a sketch of frequent items: at most 1 / ``share`` of them, and perhaps some a little below."""
    most = math.ceil(1 / share)
    names = ", ".join("`" + name.replace("`", "``") + "`" for name in on)
    found = df.agg(F.expr(f"approx_top_k(xxhash64({names}), {2 * most}, {SKETCH_ITEMS * most})").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    return [item["item"] for item in found["top"] or [] if item["item"] is not None and item["count"] >= share * found["rows"]]


def hot_join(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner", share: float = 0.01, salts: int = 64) -> DataFrame:
    """``df`` joined (inner or left) with ``other`` by key, where a few keys may hold much of ``df``.

    Only the rows of heavy keys are dealt over ``salts`` parts, and only these keys' rows of ``other`` are copied to each of
    them; all other keys meet as they would. The adaptive skew join acts on large partitions alone, and splits what was shuffled already.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep each row of one side in one place")
    heavy = heavy_keys(df, on, share)
    if not heavy:
        return df.join(other, list(on), how)
    hot = F.xxhash64(*on).isin(heavy)
    dealt = df.withColumn("__salt", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copied = other.withColumn("__salt", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")
