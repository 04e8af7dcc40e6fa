"""Connected components by minimum labels with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.shared import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest reachable node.

    Each round takes the smallest label among a node's neighbours and then the label that that one had,
    so chains shorten by half or more. A round's labels are checkpointed: lost executors cost a round at
    most. Joins meet a hub's links, or the members of a large component, with one row of labels;
    both sides are shuffled for the join alone, so that Spark can split such a key (adaptive skew
    join), and what is joined is folded by partial sums. Self links, repeated and null-ended links are ignored.
    """
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node <> next")
    both = checkpointed(pairs.union(pairs.select(F.col("next"), F.col("node"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")))
    while True:
        theirs = labels.select(F.col("node").alias("next"), F.col("label").alias("theirs"))
        near = both.join(theirs, "next").groupBy("node").agg(F.min("theirs").alias("theirs"))
        better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        tops = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = checkpointed(better.join(tops, "label").select("node", F.col("top").alias("label"), (F.col("top") < F.col("old")).alias("moved")))
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
