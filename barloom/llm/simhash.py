"""SimHash near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is the bitwise majority over the XXH64 values of a text's word shingles.
Fingerprints at Hamming distance ``RADIUS`` = 3 or less are linked, and documents that are
connected through links form a component named by its smallest doc_id.

The index keeps each distinct fingerprint under its two 32-bit halves. Two fingerprints that
differ in at most three bits differ in at most one bit in one half, so probing the ball of
radius one around each half (33 keys) finds every link; the full distance is then verified in
the join. Where very many fingerprints share a half, the other half is looked up as well, in
the same way by its quarters. Copies share a fingerprint and are folded before the join, so a group of copies
costs one row however large it is.

Defined cases: null and empty texts have fingerprint 0 and link like any other; a text of
fewer than three words is one shingle; rows with a null doc_id keep their fingerprint and take
the component of that fingerprint; repeated rows stay as they are; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.components import connected_components
from barloom.llm.util import broadcast_up_to
from barloom.sources.shared import checkpointed

RADIUS = 3
SEED = 42
SHINGLE = 3
HALF, QUARTER = 32, 16
#: Fingerprints with one half in common from which on their other halves are looked up too, and so many crowded halves are broadcast at most.
CROWD, BROADCAST_KEYS = 1000, 50_000
#: Shingles whose bits are counted at once; bounds the memory of a very long text.
BLOCK = 1 << 16

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower(): A-Z only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    total = len(words) - SHINGLE + 1
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


@F.pandas_udf(T.LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The SimHash of each text as a signed 64-bit column."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if segment == 0 else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _keys(fp: Column) -> Column:
    """The index key of each half: its 32 bits, with the segment's number above them."""
    return F.array(_half(fp, 0), _half(fp, 1).bitwiseOR(F.lit(1 << HALF)))


def _ball(bits: int) -> Column:
    """The differences of at most one bit among ``bits``."""
    return F.array(F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(bits)])


def _quarters(fp: Column, key: Column) -> Column:
    """The two 16-bit parts of the half that ``key`` is not about, each with its number above it."""
    other = F.when(F.shiftright(key, HALF) == 0, _half(fp, 1)).otherwise(_half(fp, 0))
    return F.array(F.shiftright(other, QUARTER), other.bitwiseAND(F.lit((1 << QUARTER) - 1)).bitwiseOR(F.lit(1 << QUARTER)))


def hamming_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints at distance RADIUS or less, each pair once.

    ``fps`` holds distinct fingerprints in ``fp``. Where more than ``CROWD`` fingerprints share a
    half, pairs are looked up by the other half too: it differs in three bits at most, so one of
    its quarters in one at most. No key then meets all pairs of a crowd.
    """
    fp = F.col("fp")
    table = fps.select(fp.alias("b"), F.explode(_keys(fp)).alias("key"))
    crowds = checkpointed(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"))
    halves = fps.select(fp.alias("a"), F.explode(_keys(fp)).alias("half"))
    probe = halves.select("a", F.explode(F.transform(_ball(HALF), lambda mask: F.col("half").bitwiseXOR(mask))).alias("key"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    verified = (F.col("a") < F.col("b")) & (F.bit_count(differing) <= RADIUS)
    if crowds.isEmpty():
        found = probe.join(table, "key").where(verified)
    else:
        crowds = broadcast_up_to(crowds, BROADCAST_KEYS)
        alone = probe.join(crowds, "key", "left_anti").join(table.join(crowds, "key", "left_anti"), "key").where(verified)
        parts = table.join(crowds, "key", "left_semi").select("b", "key", F.explode(_quarters(F.col("b"), F.col("key"))).alias("quarter"))
        asked = probe.join(crowds, "key", "left_semi").select("a", "key", F.explode(_quarters(F.col("a"), F.col("key"))).alias("quarter"))
        asked = asked.select("a", "key", F.explode(F.transform(_ball(QUARTER), lambda mask: F.col("quarter").bitwiseXOR(mask))).alias("quarter"))
        found = alone.select("a", "b").unionByName(asked.join(parts, ["key", "quarter"]).where(verified).select("a", "b"))
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    marked = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp")))
    fps = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    named = fps.select("fp", "node")
    links = (
        hamming_links(fps)
        .join(named.select(F.col("fp").alias("a"), F.col("node").alias("src")), "a")
        .join(named.select(F.col("fp").alias("b"), F.col("node").alias("dst")), "b")
    )
    joined = connected_components(links)
    groups = named.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one of the smallest doc_id.

    Rows that share a doc_id count as one document if any of them is kept. Rows without a doc_id
    can't be named and stay.
    """
    own = F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("own")
    decided = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(own, F.count("*").alias("rows")).where("own = 1")
    decided = checkpointed(decided.select("doc_id", "rows"))
    single = docs.join(decided.where("rows = 1"), "doc_id", "left_semi")
    repeated = docs.join(decided.where("rows > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).unionByName(docs.where("doc_id is null"))
