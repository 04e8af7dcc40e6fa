"""Sharding by extendible hashing, in DataFrame operations only.

Each key has ``HASH_BITS`` hash bits. The directory starts with one bucket; a bucket whose
rows exceed the byte limit, and only such a bucket, splits on its next hash bit until every
bucket fits. A shard is named ``b`` plus the prefix bits of its bucket.

Byte sums are taken once per fine prefix cell (partial sums before the shuffle). The sums of shorter
prefixes are made from those of longer ones, ``STEP`` bits at a time, so that no prefix gathers more
than 2 ** STEP rows. The directory is the prefixes that fit below prefixes that don't; cells look it up
at its depths alone. The cells' number follows the number of shards, not the rows. Only rows below cells
that are still too large go on to the next bits.

Defined cases: a null text has 0 bytes; a null key hashes as the empty string; all rows of one
key stay together, so a bucket that holds a single key is final even if it is larger than the
limit (``shard_bytes`` shows it); repeated rows each count and each come back; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.util import broadcast_up_to, hash_number
from barloom.sources.shared import checkpointed

HASH_BITS = 60
LIMIT = 4 << 20
#: Bits below the expected depth that the first cells have, and bits that are gone down, or summed up, at a time.
SPARE, STEP = 4, 8
#: A table of so many cells (24 bytes each) is broadcast at most.
BROADCAST_CELLS = 1 << 16


def key_hash(key: Column) -> Column:
    return hash_number(F.coalesce(key.cast("string"), F.lit("")), HASH_BITS // 4)


def _prefix(bits: str, depth: str) -> Column:
    return F.expr(f"shiftright(prefix, {bits} - {depth})")


def _sums(cells: DataFrame, low: int, bits: int) -> DataFrame:
    """(depth, prefix, bytes, lo, hi) of all prefixes of ``low`` to ``bits`` bits, from cells (cell, bytes, lo, hi) of ``bits`` bits."""
    level = cells.select(F.lit(bits).alias("depth"), F.col("cell").alias("prefix"), "bytes", "lo", "hi")
    found = [level]
    for deepest in range(bits, low, -STEP):
        shorter = F.explode(F.sequence(F.lit(max(low, deepest - STEP)), F.lit(deepest - 1)))
        above = level.withColumnRenamed("depth", "own").withColumn("depth", shorter).withColumn("prefix", _prefix("own", "depth"))
        above = checkpointed(above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        found.append(above)
        level = above.where(F.col("depth") == max(low, deepest - STEP))
    return reduce(DataFrame.unionByName, found)


def directory(cells: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes): the buckets that splitting from prefixes of ``low`` bits on ends with, down to ``bits``; too large ones of ``bits`` are left out.

    A bucket is final if it fits or holds a single hash, and in the directory if its parent isn't. All prefixes of ``low`` bits are taken to have split off.
    """
    sums = _sums(cells, low, bits).withColumn("final", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
    split = sums.where("not final").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    below = sums.where(F.col("final") & (F.col("depth") > low)).withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"], "left_semi")
    return sums.where(F.col("final") & (F.col("depth") == low)).unionByName(below.select(sums.columns)).select("depth", "prefix", F.col("bytes").alias("shard_bytes"))


def _leaves(cells: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes): each cell's bucket, with a null depth where none down to ``bits`` fits."""
    buckets = checkpointed(directory(cells, low, bits, limit))
    depths = buckets.agg(F.min("depth"), F.max("depth")).first()
    if depths[0] is None:
        return cells.select("cell", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("shard_bytes"))
    paths = cells.select("cell", F.explode(F.sequence(F.lit(depths[0]), F.lit(depths[1]))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    found = paths.join(broadcast_up_to(buckets, BROADCAST_CELLS), ["depth", "prefix"]).select("cell", "depth", "shard_bytes")
    return cells.select("cell").join(found, "cell", "left")


def extendible_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes) of every row of ``docs``."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = checkpointed(docs.select(F.col(key), size.alias("n_bytes"), key_hash(F.col(key)).alias("hash")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, bits = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    done: list[DataFrame] = []
    while True:
        placed = rows.withColumn("cell", F.shiftright("hash", HASH_BITS - bits))
        cells = placed.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        leaves = checkpointed(_leaves(cells, low, bits, limit))
        found = placed.join(broadcast_up_to(leaves, BROADCAST_CELLS), "cell")
        prefix = F.expr(f"shiftright(cell, {bits} - depth)")
        shard = F.concat(F.lit("b"), F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), F.col("depth"), F.lit("0"))))
        done.append(found.where("depth is not null").select(key, "n_bytes", shard.alias("shard"), "depth", "shard_bytes"))
        if bits == HASH_BITS or leaves.where("depth is null").isEmpty():
            break
        rows = found.where("depth is null").select(key, "n_bytes", "hash")
        low, bits = bits + 1, min(HASH_BITS, bits + STEP)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes ``docs`` as Parquet folders ``shard=...``, each shard by one task; keys must be unique and not null."""
    docs.join(shards.select(key, "shard"), key).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL of ``extendible_shards`` over documents."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     p AS (SELECT d.*, g.depth, h >> ({HASH_BITS} - g.depth) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS depth) g),
     b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, min(h) = max(h) AS single FROM p GROUP BY ALL),
     l AS (SELECT p.doc_id, p.n_bytes, b.depth, b.prefix, b.shard_bytes,
                  row_number() OVER (PARTITION BY p.doc_id ORDER BY b.depth) AS rn
           FROM p JOIN b ON p.depth = b.depth AND p.prefix = b.prefix WHERE b.shard_bytes <= {limit} OR single)
SELECT doc_id, n_bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::INT AS depth, shard_bytes FROM l WHERE rn = 1"""
