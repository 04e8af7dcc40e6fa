import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], top: int) -> dict:
    vectors = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 1024).astype(int)) for i, v in rows]
    out = {}
    for query in {i for i, _ in vectors if i % 100 == 0}:
        q = next(v for i, v in vectors if i == query)
        scored = sorted((-int(v @ q), i) for i, v in vectors if i != query)
        out[query] = [(i, -s) for s, i in scored[:top]]
    return out


def grouped(df) -> dict:
    out: dict = {}
    for row in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(out[row["query_id"]])
    return out


@pytest.mark.parametrize("sizes", [topk.SIZES, topk.Sizes(7, 2000, 300, 1500)])
def test_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) / 10).round(1).tolist()) for i in range(700)]  # rounded, so that scores tie
    usable = topk.usable(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    assert grouped(topk.exact_top_k(usable, usable.where("vec_id % 100 = 0"), sizes=sizes)) == brute(rows, 10)


def test_large_components(spark):
    rows = [(0, [3.0e4, 1.0]), (1, [3.0e4, -5.0e7]), (2, [-1.0, 2.0e9]), (3, [0.0, 0.0])]
    usable = topk.usable(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    assert grouped(topk.exact_top_k(usable, usable.where("vec_id % 100 = 0"))) == brute(rows, 10)


def test_repeated_rows_and_wide_vectors(spark):
    """A candidate row that is there twice counts twice, a query that is there twice is asked once; 3,000 components."""
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.normal(size=3000), 2).tolist()) for i in range(30)]
    usable = topk.usable(spark.createDataFrame([(i, v, 0) for i, v in [*rows, rows[0], rows[0], *rows[10:14]]], SCHEMA))
    want = {q: [(i, s) for i, s in found for _ in range(2 if 10 <= i < 14 else 1)][:10] for q, found in brute(rows, 10).items()}
    assert grouped(topk.exact_top_k(usable, usable.where("vec_id % 100 = 0"))) == want


@pytest.mark.parametrize("rows", [[(0, [1.0e20]), (1, [1.0])], [(0, [3.0e12]), (1, [3.0e12])]])
def test_what_does_not_fit_is_refused(spark, rows):
    usable = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits|too (large|big)|[Oo]verflow"):
        topk.exact_top_k(usable, usable.where("vec_id % 100 = 0")).collect()


def test_pruning_across_slices(spark):
    """Of clustered vectors a query scores few blocks, although they lie in many slices; nothing is missed."""
    sizes = topk.Sizes(64, 64 * 16 * 8 * 4)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) / 50).round(3).tolist()) for i in range(8000)]
    usable = topk.usable(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    asked = usable.where("vec_id % 100 = 0")
    blocks = topk.packed(usable.withColumn("least", F.lit(None).cast("long")), sizes)
    n_blocks, n_slices = blocks.count(), blocks.select("slice").distinct().count()
    found = topk.hits(usable, asked, sizes=sizes).select("query_id", "blocks", F.spark_partition_id().alias("cell"), "vec_id").collect()
    scored = sum({(row["query_id"], row["cell"], row["blocks"]): row["blocks"] for row in found}.values())
    assert n_slices > 20 and scored < 0.2 * 80 * n_blocks
    assert grouped(topk.exact_top_k(usable, asked, sizes=sizes)) == brute(rows, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, nan]), (200, None), (300, [inf, 0.0]), (None, [1.0, 1.0]), (1, [1.0, None]), (2, [0.5]), (3, [0.5, 9.0]), (400, [1.0, 0.0])]
    usable = topk.usable(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).withColumn("block", F.lit("clash")))
    found = grouped(topk.exact_top_k(usable, usable.where("vec_id % 100 = 0")))
    assert found == {0: [(400, 1024**2), (2, 512 * 1024), (3, 512 * 1024)], 400: [(0, 1024**2), (2, 512 * 1024), (3, 512 * 1024)]}
    none = topk.usable(spark.createDataFrame([], SCHEMA))
    assert topk.exact_top_k(none, none).collect() == [] and topk.exact_top_k(none, usable).collect() == [] == topk.exact_top_k(usable, none).collect()
