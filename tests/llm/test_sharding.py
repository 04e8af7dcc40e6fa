import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import sharding


def brute(rows: list[tuple], limit: int) -> dict:
    """Splits buckets one bit at a time."""
    done, waiting = {}, [("", [(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], i, n) for i, n in rows])]
    while waiting:
        prefix, bucket = waiting.pop()
        if sum(n for _, _, n in bucket) <= limit or len({h for h, _, _ in bucket}) == 1:
            done |= {i: (f"b{prefix}", sum(n for _, _, n in bucket)) for _, i, _ in bucket}
            continue
        parts = defaultdict(list)
        for entry in bucket:
            parts[bin(int(entry[0], 16))[2:].zfill(60)[len(prefix)]].append(entry)
        waiting += [(prefix + bit, part) for bit, part in parts.items()]
    return done


@pytest.mark.parametrize("limit", [1, 50, 3000, 10**6])
def test_against_splitting_one_by_one(spark, limit):
    rows = [(i, "x" * (i % 97)) for i in range(300)] + [(7, "y" * 5000)]
    found = sharding.extendible_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    want = brute([(i, len(t)) for i, t in rows], limit)
    assert len(found) == len(rows) and {row["doc_id"]: (row["shard"], row["shard_bytes"]) for row in found} == want
    assert all(row["shard_bytes"] <= limit or row["doc_id"] == 7 or row["n_bytes"] > limit for row in found)


def test_directory_tiles_the_hashes(spark):
    """Every hash has one bucket, each fits or is a single hash, and no two buddies would fit together."""
    rows = [(i, "x" * (i * i % 997)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", sharding.key_hash(F.col("doc_id")))
    bits, limit = 20, 9000
    cells = docs.groupBy(F.shiftright("hash", sharding.HASH_BITS - bits).alias("cell")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    found = {(row["depth"], row["prefix"]): row["shard_bytes"] for row in sharding.directory(cells, 0, bits, limit).collect()}
    sizes: dict[tuple[int, int], int] = dict.fromkeys(found, 0)
    for row in docs.select("hash", F.length("text").alias("n")).collect():
        (own,) = [(d, p) for d, p in found if row["hash"] >> (sharding.HASH_BITS - d) == p]
        sizes[own] += row["n"]
    assert sizes == found and max(found.values()) <= limit
    for (depth, prefix), size in found.items():
        buddy = found.get((depth, prefix ^ 1))
        assert buddy is None or size + buddy > limit


def test_odd_documents(odd_documents, no_documents):
    rows = sharding.extendible_shards(odd_documents, 1000).collect()
    assert len(rows) == odd_documents.count()
    assert len({row["shard"] for row in rows if row["doc_id"] == 1}) == 1
    assert sharding.extendible_shards(no_documents).collect() == []


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = sharding.extendible_shards(docs, 60_000)
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == shards.select("shard").distinct().count() > 1
