import hashlib

import numpy as np
import pytest

from barloom.llm import centroids

ROWS = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, width, scale=centroids.SCALE):
    """(id, cluster, distance) by comparing every vector with every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    means = [v for *_, v in named[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)) for _, v in kept]
        if n < rounds:
            for c in range(len(means)):
                own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == c]
                means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else means[c]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, found, strict=True)), key=repr), means


@pytest.mark.parametrize(("k", "width", "spread"), [(4, 3, 1.0), (7, 2, 0.05), (16, 5, 300.0), (50, 3, 1.0)])
def test_against_all_pairs(spark, monkeypatch, k, width, spread):
    """Ties (few different integers), repeated rows and ids, null ids, rows that take no part, empty clusters, more centroids than vectors, small blocks."""
    monkeypatch.setattr(centroids, "BLOCK", 7)
    rng = np.random.default_rng(k)
    rows = [(int(i) if i else None, [float(x) for x in rng.normal(size=width) * spread]) for i in rng.integers(0, 60, 90)][: 40 if k == 50 else 90]
    rows += [rows[3], rows[3], (5, None), (6, [1.0] * (width + 1)), (7, [float("nan")] * width), (8, [float("inf")] * width), (9, [None] * width), (10, [])]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    made, means = centroids.sort_means(df, k, 3, width)
    want, wanted_means = plain(rows, k, 3, width)
    found = made.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=repr) == want and means.tolist() == wanted_means
    by_cluster = {c: sum(d for _, at, d in want if at == c) for _, c, _ in want}
    assert all(r["cluster_inertia"] == by_cluster[r["cluster"]] and r["inertia"] == sum(by_cluster.values()) for r in found)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, wanted_means[r["cluster"]])).encode()).hexdigest() for r in found)


def test_large_components_are_exact_or_refused(spark):
    rows = [(k, [(-1.0) ** k * (1_900_000 - k), float(k * 1000)]) for k in range(30)]
    made, _ = centroids.sort_means(spark.createDataFrame(rows, ROWS), 3, 2, 2)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in made.collect()), key=repr) == plain(rows, 3, 2, 2)[0]
    with pytest.raises(Exception, match="beyond"):
        centroids.sort_means(spark.createDataFrame([(1, [3e9, 0.0])], ROWS), 3, 2, 2)


def test_bounds_save_distances():
    """In tight clusters a vector meets few centroids, with the same result."""
    rng = np.random.default_rng(1)
    means = rng.integers(-5000, 5000, (40, 8))
    points = means[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 8))
    want = centroids.squared(points, means)
    clusters, distances, taken = centroids.nearest(points, means, want.argmin(axis=1).astype(np.int32))
    assert (clusters == want.argmin(axis=1)).all() and (distances == want.min(axis=1)).all() and taken < 1.2 * len(points)
    clusters, distances, _ = centroids.nearest(points, means, np.zeros(3000, np.int32))
    assert (clusters == want.argmin(axis=1)).all() and (distances == want.min(axis=1)).all()


def test_the_bound_itself_is_still_compared():
    """A centroid exactly twice as far from the own one as the vector is ties, and the smaller number wins."""
    means = np.array([[4, 0], [0, 0]])
    clusters, distances, taken = centroids.nearest(np.array([[2, 0]]), means, np.array([1], np.int32))
    assert clusters.tolist() == [0] and distances.tolist() == [4] and taken == 2


def test_no_rows(spark):
    made, means = centroids.sort_means(spark.createDataFrame([(1, None)], ROWS))
    assert made.collect() == [] and len(means) == 0 and made.columns == centroids.ASSIGNED.names


def test_names_may_clash(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0], "x", "y") for k in range(5)], "n long, v array<double>, cluster string, hash string")
    assert centroids.sort_means(rows, 2, 1, 2, vec_id="n", embedding="v")[0].count() == 5
