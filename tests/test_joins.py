"""Joins with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.joins import heavy_keys, hot_join


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_joins_equal_plain_ones(spark, how):
    """One heavy key, none, several rows a key on both sides, null keys, keys without a partner, two key columns."""
    rng = random.Random(1)
    left = [(k, rng.choice(["hot"] * 8 + ["b", None, "none"]), k % 3) for k in range(400)]
    right = [("hot", 0, "x"), ("hot", 0, "y"), ("hot", 1, "z"), ("b", 1, "w"), (None, 1, "n"), ("alone", 2, "a")]
    a, b = spark.createDataFrame(left, "id int, k string, j int"), spark.createDataFrame(right, "k string, j int, v string")
    for on, other in ((["k"], b.drop("j")), (["k", "j"], b)):
        for share in (0.05, 0.9):
            want = a.join(other, on, how)
            found = hot_join(a, other, on, how, share=share, salts=5)
            assert found.columns == want.columns and rows_of(found) == rows_of(want)
    assert hot_join(a.limit(0), b, ["k", "j"]).collect() == []
    with pytest.raises(ValueError, match="inner and left"):
        hot_join(a, b, ["k", "j"], "full")


def test_a_key_with_nine_rows_of_ten_is_many_tasks(spark):
    big = spark.range(200_000).select("id", F.when(F.col("id") % 10 < 9, -1).otherwise(F.col("id")).alias("k"))
    small = spark.range(-1, 200_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert len(heavy_keys(big, ["k"], 0.01)) == 1 and heavy_keys(small, ["k"], 0.01) == []
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        most = lambda df: max(row["count"] for row in df.where("k = -1").groupBy(F.spark_partition_id().alias("task")).count().collect())
        assert most(big.join(small, "k")) == 180_000
        assert most(hot_join(big, small, ["k"], salts=64)) < 40_000
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
