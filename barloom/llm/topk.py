"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers floor(SCALE * x). Candidates are ordered by a locality key (the signs
of fixed pseudo-random projections) and cut into blocks of consecutive rows; a block is a
forward index: its ids and its dense integer matrix (in the smallest integers that hold it), from which
each term's maximum and minimum over the block are taken. For a query a block can score at most the sum over terms of weight times maximum
(minimum for negative weights). A query visits blocks in falling order of that bound and stops
at the first block whose bound is below its k-th score, so no result is ever missed.

Consecutive blocks form slices of bounded bytes. What meets every query is the blocks' maxima
and minima alone: they name each query's most promising blocks, which are scored first (``seeded``)
and give a k-th score to beat; then they name the slices that may still beat it. Only
these queries go to these slices, a slice is shipped once for each group of queries that
ask for it, and within it the rest is pruned block by block. Where bounds prune nothing, that comes
to all pairs in blocks. The maxima and minima (two rows for each block) are shipped once for each
group of queries in any case.

Defined cases: a vector that is null or has a null or non-finite component, or a row without
an id, takes no part; a shorter vector counts as filled up with zeros; equal scores rank by
smaller id; a repeated query id is asked once; repeated candidate rows each count; a query has
fewer than k rows if there are fewer candidates; components and scores that don't fit 64 bits are refused
with an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.llm.util import broadcast_up_to, fields
from barloom.sources.shared import checkpointed

SCALE = 1024
TOP = 10


class Sizes(NamedTuple):
    """Rows of a block; bytes of a slice's matrices, of a query group's matrix, and of the maxima and minima that one task meets a group with."""

    block: int = 256
    slice_bytes: int = 4 << 20
    group_bytes: int = 4 << 20
    bound_bytes: int = 16 << 20


SIZES = Sizes()
#: Blocks of the highest bound that give a query's first k-th score.
SEEDS = 2
#: Slices whose number of copies is broadcast at most.
BROADCAST_SLICES = 100_000
#: Bits of the locality key.
PROJECTIONS = 16
#: Doubles hold every integer up to this exactly.
EXACT = float(1 << 53)
#: No score to beat.
NONE = np.iinfo(np.int64).min

PACKED = fields(slice="long", ids="binary", least="binary", matrix="binary", size="int", high="binary", low="binary")
ASKED = fields(slice="long", part="long", ids="binary", least="binary", bound="binary", matrix="binary", size="int")
HITS = fields(query_id="long", vec_id="long", score="long", blocks="long")


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the rows that take part, as integer vectors."""
    infinite, limit = F.lit(float("inf")), F.lit(float(1 << 63))
    sound = F.col(vec_id).isNotNull() & F.coalesce(
        F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != infinite), F.lit(False))), F.lit(False)
    )
    scaled = lambda x: x.cast("double") * scale
    whole = F.transform(embedding, lambda x: F.when(F.abs(scaled(x)) < limit, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long")))
    return vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("vector"))


@F.pandas_udf(T.IntegerType())
def locality(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The signs of PROJECTIONS fixed projections of each vector, as bits."""
    for batch in vectors:
        dense = _dense(batch)
        signs = np.random.default_rng(0).standard_normal((dense.shape[1], PROJECTIONS))
        yield pd.Series(((dense @ signs > 0) @ (1 << np.arange(PROJECTIONS))).astype(np.int32))


def _dense(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of one matrix, zero-filled to the longest."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest integers that hold it, which is what is shuffled."""
    reach = (matrix.min(initial=0), matrix.max(initial=0))
    return matrix.astype(next(kind for kind in (np.int16, np.int32, np.int64) if np.iinfo(kind).min <= reach[0] and reach[1] <= np.iinfo(kind).max))


def _pack(sizes: Sizes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Consecutive rows as blocks, and consecutive blocks as slices."""
        here, number, filled = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            made = []
            for at in range(0, len(batch), sizes.block):
                part = batch.iloc[at : at + sizes.block]
                ids, dense, least = part["vec_id"].to_numpy(np.int64), _narrow(_dense(part["vector"])), part["least"].to_numpy(np.int64)
                if filled and filled + dense.size * 8 > sizes.slice_bytes:
                    number, filled = number + 1, 0
                filled += dense.size * 8
                high, low = dense.max(axis=0), dense.min(axis=0)
                made.append((here + number, ids.tobytes(), least.tobytes(), dense.tobytes(), dense.itemsize, high.tobytes(), low.tobytes()))
            yield pd.DataFrame(made, columns=PACKED.names)

    return pack


def packed(rows: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """``rows`` (vec_id, vector, least) as blocks of rows that lie together."""
    keyed = rows.withColumn("near", locality("vector"))
    together = keyed.repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
    return together.select("vec_id", "vector", F.coalesce("least", F.lit(NONE)).alias("least")).mapInPandas(_pack(sizes), PACKED)


def _rows(data: bytes, size: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{size}").reshape(n, -1)


def _stacked(parts: list[np.ndarray], width: int) -> np.ndarray:
    return np.concatenate([np.pad(part, ((0, 0), (0, width - part.shape[1]))).astype(np.int64) for part in parts])


def _matrices(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each row of a packed frame."""
    return [(ids := np.frombuffer(i, np.int64), _rows(m, size, len(ids))) for i, m, size in zip(frame["ids"], frame["matrix"], frame["size"], strict=True)]


def _exact_kind(queries: np.ndarray, others: np.ndarray) -> type:
    """Doubles where they hold all sums exactly, else Python's integers."""
    reach = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    return np.float64 if reach(queries) * reach(others) * queries.shape[1] < EXACT else np.object_


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(query, block): what a block can score at most."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _ask(top: int, seeding: bool, chunk: int):
    """What of a group of queries goes to which slice: while ``seeding`` its best blocks', then those that may beat its k-th score."""

    def ask(blocks: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(groups):
            return pd.DataFrame(columns=ASKED.names)
        asked = _matrices(groups)
        edges = [(_rows(h, size, 1), _rows(w, size, 1)) for h, w, size in zip(blocks["high"], blocks["low"], blocks["size"], strict=True)]
        width = max(m.shape[1] for m in [m for _, m in asked] + [h for h, _ in edges])
        queries, ids = _stacked([m for _, m in asked], width), np.concatenate([i for i, _ in asked])
        high, low = (_stacked([edge[side] for edge in edges], width) for side in (0, 1))
        kind = _exact_kind(queries, np.concatenate([high, low]))
        high, low, sizes, slices = high.astype(kind), low.astype(kind), blocks["n"].to_numpy(), blocks["slice"].to_numpy()
        least, made = np.concatenate([np.frombuffer(x, np.int64) for x in groups["least"]]), []
        for at in range(0, len(ids), chunk):
            some, own, beat = queries[at : at + chunk], ids[at : at + chunk], least[at : at + chunk]
            bounds = _bounds(some.astype(kind), high, low)
            if seeding:
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                enough = np.maximum((before <= top).sum(axis=1), min(SEEDS, len(sizes)))
                bound = bounds[np.arange(len(own)), order[np.arange(len(own)), enough - 1]]
            else:
                bound = beat.astype(kind)
            wanted = bounds >= bound[:, None]
            if not seeding:
                wanted |= (beat == NONE)[:, None]
            for number in np.unique(slices):
                rows = np.flatnonzero(wanted[:, slices == number].any(axis=1))
                if len(rows):
                    matrix = _narrow(some[rows])
                    made.append((number, int(own[0]), own[rows].tobytes(), beat[rows].tobytes(), bound[rows].astype(np.float64).tobytes(), matrix.tobytes(), matrix.itemsize))
        return pd.DataFrame(made, columns=ASKED.names)

    return ask


def _search(top: int, seeding: bool):
    """A slice's best for the queries that ask for it; ``blocks`` tells how many of its blocks a query scored."""

    def search(blocks: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        index, asked = _matrices(blocks), _matrices(groups)
        if not index or not asked:
            return pd.DataFrame(columns=HITS.names)
        width = max(m.shape[1] for _, m in index + asked)
        queries, query_ids = _stacked([m for _, m in asked], width), np.concatenate([ids for ids, _ in asked])
        whole = _stacked([m for _, m in index], width)
        kind = _exact_kind(queries, whole)
        ends = np.cumsum([0, *[len(ids) for ids, _ in index]])
        index = [(ids, whole[a:b].astype(kind)) for (ids, _), a, b in zip(index, ends, ends[1:], strict=False)]
        queries = queries.astype(kind)
        bounds = _bounds(queries, np.stack([m.max(axis=0) for _, m in index]), np.stack([m.min(axis=0) for _, m in index]))
        to_beat = np.concatenate([np.frombuffer(x, np.int64) for x in groups["least"]])
        wanted = np.concatenate([np.frombuffer(x, np.float64) for x in groups["bound"]])
        found = []
        for at, (query_id, query, bound) in enumerate(zip(query_ids, queries, bounds, strict=True)):
            best_ids, best, seen = np.empty(0, np.int64), np.empty(0, kind), 0
            least = None if to_beat[at] == NONE else kind(to_beat[at]) if kind is np.float64 else int(to_beat[at])
            for b in np.argsort(-bound, kind="stable"):
                if least is not None and bound[b] < least or seeding and float(bound[b]) < wanted[at]:
                    break
                ids, matrix = index[b]
                scores, seen = matrix @ query, seen + 1
                keep = ids != query_id if least is None else (ids != query_id) & (scores >= least)
                if not keep.any():
                    continue
                best_ids, best = np.concatenate([best_ids, ids[keep]]), np.concatenate([best, scores[keep]])
                order = np.lexsort((best_ids, -best))[:top]
                best_ids, best = best_ids[order], best[order]
                if len(best) == top:
                    least = best[-1]
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": best_ids, "score": best.astype(np.int64), "blocks": seen}))
        return pd.concat(found)

    return search


def _met(blocks: DataFrame, queries: DataFrame, top: int, seeding: bool, sizes: Sizes) -> DataFrame:
    """HITS of ``queries`` (vec_id, vector, least) from the slices that they ask for."""
    groups = checkpointed(packed(queries, sizes))
    widened = lambda part: F.sum(F.octet_length(part) * F.lit(8) / F.col("size"))
    pieces = lambda df, part, limit: max(1, math.ceil((df.agg(widened(part)).first()[0] or 0) / limit))
    sections, parts = pieces(blocks, "high", sizes.bound_bytes // 2), pieces(groups, "matrix", sizes.group_bytes)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    edges = blocks.select("slice", (F.octet_length("ids") / 8).cast("long").alias("n"), "size", "high", "low", F.pmod(F.xxhash64("slice"), F.lit(sections)).cast("int").alias("section"), each(parts, "group"))
    grouped = groups.select("ids", "least", "matrix", "size", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("group"), each(sections, "section"))
    asked = checkpointed(edges.groupBy("section", "group").cogroup(grouped.groupBy("section", "group")).applyInPandas(_ask(top, seeding, sizes.block), ASKED))
    copies = asked.groupBy("slice").agg(F.greatest(F.lit(1), F.ceil(widened("matrix") / sizes.group_bytes)).cast("int").alias("copies"))
    copies = broadcast_up_to(checkpointed(copies), BROADCAST_SLICES)
    left = blocks.select("slice", "ids", "matrix", "size").join(copies, "slice").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    right = asked.join(copies, "slice").withColumn("copy", F.pmod(F.xxhash64("part"), F.col("copies")).cast("int"))
    return left.groupBy("slice", "copy").cogroup(right.groupBy("slice", "copy")).applyInPandas(_search(top, seeding), HITS)


def seeded(blocks: DataFrame, queries: DataFrame, top: int, sizes: Sizes = SIZES) -> DataFrame:
    """``queries`` with ``least``: the k-th best score within a query's most promising blocks, or null."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = _met(blocks, queries, top, True, sizes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top)
    return queries.drop("least").join(ranked.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")), "vec_id", "left")


def hits(candidates: DataFrame, queries: DataFrame, top: int = TOP, sizes: Sizes = SIZES) -> DataFrame:
    """HITS: the best of each slice for each query that reaches it, the ``top`` best over all among them."""
    blocks = checkpointed(packed(candidates.withColumn("least", F.lit(None).cast("long")), sizes))
    asked = queries.dropDuplicates(["vec_id"]).withColumn("least", F.lit(None).cast("long"))
    if blocks.select("slice").distinct().count() > 1:  # within one slice a search finds its k-th score by itself
        asked = seeded(blocks, asked, top, sizes)
    return _met(blocks, asked, top, False, sizes)


def exact_top_k(candidates: DataFrame, queries: DataFrame, top: int = TOP, sizes: Sizes = SIZES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` best candidates of each query.

    Both inputs are rows of ``usable``. A query's own id is never its candidate.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits(candidates, queries, top, sizes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(top: int = TOP) -> str:
    """DuckDB SQL of the registered search over embeddings."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {top}"""
