"""Centroid clustering by sort-means over exact integers.

Vectors become integers floor(scale * x) and lie in blocks (ids, a matrix in the smallest integers that hold
it, and each row's cluster), so a round is one pass over blocks. Each round orders the other centroids by
their distance from each centroid; a vector starts at the centroid that it was assigned to before and goes
through the others in that order, stopping at the first that is strictly more than twice as far from that
centroid as the vector is: by the triangle inequality neither it nor any behind it can be nearer. What stays
equal is still compared, so that ties go to the smaller number. A block gives its clusters' counts and sums, which Spark
adds up; only these (``k`` rows of the vectors' length) come to the driver, which floors the means.

Rounds are written to the shared folder, and the one before is deleted then; a lost executor costs a part
of one round.

Defined cases: a vector that is null, has another length than ``components`` or a null or non-finite
component takes no part; rows without an id are assigned, but give a first centroid only if there are fewer
ids than centroids; repeated rows each count, and of equal ids the smaller vector comes first; with fewer
than ``k`` vectors there are as many centroids; components beyond ``REACH`` are refused with an error, as
their squared distances wouldn't fit 64 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.util import fields
from barloom.sources.shared import checkpointed, removed, shared_dir

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
SEED = "1"
#: Rows of a block.
BLOCK = 4096
#: What integers have to be smaller than.
REACH = 1 << 27
#: Doubles hold every integer up to this exactly.
EXACT = 1 << 53

LONGS = T.ArrayType(T.LongType())
BLOCKS = fields(ids=LONGS, matrix="binary", size="int", clusters="binary", distances="binary", counts=LONGS, sums=LONGS, inertia=LONGS)
ASSIGNED = fields(vec_id="long", cluster="int", distance="long", cluster_inertia="long", inertia="long", centroid_sha256="string")

Batches = Iterator[pa.RecordBatch]


def usable(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, in doubles."""
    infinite = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != infinite), F.lit(False)))
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    return named.where((F.size("vector") == components) & F.coalesce(finite, F.lit(False)))


def _kind(*matrices: np.ndarray) -> type:
    """Doubles where squared distances stay exact in them, else integers."""
    reach = max(int(np.abs(m).max(initial=0)) for m in matrices)
    return np.float64 if 4 * reach * reach * matrices[0].shape[1] < EXACT else np.int64


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """(point, other): exact squared distances."""
    kind = _kind(points, others)
    points, others = points.astype(kind), others.astype(kind)
    return ((points * points).sum(axis=1)[:, None] - 2 * (points @ others.T) + (others * others).sum(axis=1)[None, :]).astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each point by sort-means from the cluster it was in ``before``, and how many distances that took."""
    kind = _kind(points, centroids)
    points, means, gaps = points.astype(kind), centroids.astype(kind), squared(centroids, centroids)
    lengths, norms = (points * points).sum(axis=1), (means * means).sum(axis=1)
    away = lambda rows, c: (lengths[rows] - 2 * (points[rows] @ means[c]) + norms[c]).astype(np.int64)
    best, least, taken = before.copy(), np.zeros(len(points), np.int64), len(points)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = least[rows] = away(rows, c)
        for other in np.argsort(gaps[c], kind="stable"):
            if other == c:
                continue
            near = own >= -(-gaps[c, other] // 4)  # the centroids are at most twice as far apart as the point is from its own
            rows, own = rows[near], own[near]
            if not len(rows):
                break
            found = away(rows, other)
            better = (found < least[rows]) | (found == least[rows]) & (other < best[rows])
            best[rows[better]], least[rows[better]] = other, found[better]
            taken += len(rows)
    return best, least, taken


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([row.tolist() for row in rows], pa.list_(pa.int64()))


def _packed(scale: int, components: int) -> Callable[[Batches], Batches]:
    """Rows of ``usable`` as blocks, all in cluster 0."""

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False) * scale).reshape(-1, components)
                if (np.abs(values) >= REACH).any():
                    raise ValueError(f"a component is beyond {REACH}")
                matrix = values.astype(next(k for k in (np.int8, np.int16, np.int32) if np.abs(values).max(initial=0) <= np.iinfo(k).max))
                none = pa.array([None], pa.binary())
                lists = pa.nulls(1, pa.list_(pa.int64()))
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                clusters = np.zeros(len(part), np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()]), pa.array([matrix.itemsize], pa.int32()), pa.array([clusters]), none, lists, lists, lists], names=BLOCKS.names)

    return pack


def _round(centroids: np.ndarray) -> Callable[[Batches], Batches]:
    """Each block with its rows' nearest centroids, and the counts, sums and inertia of the clusters in it."""
    k, width = centroids.shape

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix, size, before = (batch.column(name)[row].as_py() for name in ("matrix", "size", "clusters"))
                points = np.frombuffer(matrix, f"i{size}").reshape(-1, width)
                clusters, distances, _ = nearest(points, centroids, np.frombuffer(before, np.int32).copy())
                order = np.argsort(clusters, kind="stable")
                here, starts = np.unique(clusters[order], return_index=True)
                sums, inertia = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
                sums[here] = np.add.reduceat(points[order].astype(np.int64), starts)
                inertia[here] = np.add.reduceat(distances[order], starts)
                made = [pa.array([clusters.tobytes()]), pa.array([distances.tobytes()]), _lists([np.bincount(clusters, minlength=k)]), _lists([sums.ravel()]), _lists([inertia])]
                yield pa.RecordBatch.from_arrays([*[batch.column(name).slice(row, 1) for name in BLOCKS.names[:3]], *made], names=BLOCKS.names)

    return assign


def _added(blocks: DataFrame, name: str, n: int) -> list[int]:
    """A column of arrays, all of ``n`` numbers, added up exactly."""
    each = blocks.select(F.posexplode(name).alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    found = dict(each.collect())
    return [int(found.get(at, 0)) for at in range(n)]


def first_centroids(rows: DataFrame, k: int = CENTROIDS, scale: int = SCALE, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors of the smallest sha256 of ``seed:id``, in that order, as integers."""
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    whole = hashed.select("hash", F.transform("vector", lambda x: F.floor(x * scale)).alias("whole"))
    picked = whole.orderBy(F.asc_nulls_last("hash"), "whole").limit(k).collect()
    return np.array([row["whole"] for row in picked], np.int64)


def _unpacked(centroids: np.ndarray, inertia: list[int]) -> Callable[[Batches], Batches]:
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]

    def unpack(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                clusters = np.frombuffer(batch.column("clusters")[row].as_py(), np.int32)
                distances, ids = np.frombuffer(batch.column("distances")[row].as_py(), np.int64), batch.column("ids").slice(row, 1).flatten()
                looked_up = [pa.array(column, kind).take(pa.array(clusters)) for column, kind in ((inertia, pa.int64()), (names, pa.string()))]
                whole = pa.array(np.full(len(clusters), sum(inertia), np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(clusters), pa.array(distances), looked_up[0], whole, looked_up[1]], names=ASSIGNED.names)

    return unpack


def means(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[np.ndarray, DataFrame, str]:
    """The centroids after ``rounds``, the blocks as they were last assigned, and the folder that these lie in, which the caller deletes."""
    spark = vectors.sparkSession
    rows = usable(vectors, components, vec_id, embedding)
    centroids = first_centroids(rows, k, scale, seed).reshape(-1, components)
    n, width = centroids.shape
    folder = f"{shared_dir(spark)}/means-{uuid.uuid4().hex}"
    pack, blocks = _packed(scale, components), None
    for number in range(rounds if n else 0):
        assign = _round(centroids)
        made = blocks.mapInArrow(assign, BLOCKS) if blocks is not None else rows.mapInArrow(lambda batches, assign=assign: assign(pack(batches)), BLOCKS)
        made.write.parquet(f"{folder}/{number}")
        blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/{number}")
        if number:
            removed(spark, f"{folder}/{number - 1}")
        counts, sums = _added(blocks, "counts", n), _added(blocks, "sums", n * width)
        centroids = np.array([[sums[c * width + at] // counts[c] for at in range(width)] if counts[c] else centroids[c] for c in range(n)], np.int64)
    return centroids, rows.mapInArrow(pack, BLOCKS) if blocks is None else blocks, folder


def sort_means(vectors: DataFrame, *args: int | str, **kwargs: int | str) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part, and the final centroids; arguments as of ``means``.

    ``rounds`` times all vectors are assigned and each non-empty centroid is replaced by the floor of its vectors' mean; then they are assigned once more.
    """
    spark = vectors.sparkSession
    centroids, blocks, folder = means(vectors, *args, **kwargs)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED), np.empty((0, 0), np.int64)
    last = checkpointed(blocks.mapInArrow(_round(centroids), BLOCKS).select("ids", "clusters", "distances", "inertia"))
    removed(spark, folder)
    return last.mapInArrow(_unpacked(centroids, _added(last, "inertia", len(centroids))), ASSIGNED), centroids


def oracle_rounds(k: int, rounds: int) -> str:
    """SQL of the steps over a table ``k`` (row, vec_id, v): ``a<rounds>`` (row, vec_id, v, cluster, distance) and the centroids ``c<rounds>`` (cluster, m)."""
    away = "list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m)"
    steps = f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster, v AS m FROM k QUALIFY cluster < {k})"
    for number in range(rounds + 1):
        steps += f""", a{number} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, row({away}, cluster)) AS cluster, min({away})::BIGINT AS distance FROM k, c{number} GROUP BY row)"""
        if number < rounds:
            steps += f""", u{number} AS (SELECT cluster, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS pos FROM a{number}) GROUP BY ALL)
     , c{number + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.m, c.m) AS m FROM c{number} c LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS m FROM u{number} GROUP BY 1) n USING (cluster))"""
    return steps


def oracle() -> str:
    """DuckDB SQL of the registered clustering over embeddings; doubles hold its integers exactly."""
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     {oracle_rounds(CENTROIDS, ROUNDS)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""
