"""WARC archives with revisit records for repeated payloads.

Headers (id, URL, payload digest, size) are folded by digest and id and then shuffled by digest; the
smallest id of equal payloads is the original response and every other record becomes a revisit of it.
What was decided goes back to the pages by id: through a broadcast while it is at most
``BROADCAST_REVISITS`` rows. Beyond that a Bloom filter of the repeated digests, whose size is bounded, is broadcast instead: a page that
it excludes is a response and stays in its task, and only the others are joined by their own id. A join of headers with a very common digest is for Spark to split (adaptive
skew join): both of its sides are shuffled for it alone.

Archives hold one gzip member a record, behind a member with their ``warcinfo``, so each record can be
sought; one has at most ``archive_bytes`` or a single record, however large. Spark's text writer writes
them (a row is an archive) to any store that Spark writes to. Headers are fresh: record ids are names made of
page id and digest (random ones where these repeat), the date is that of the writing, and a revisit
names its original's record, URL and date. Reading streams through each archive by the records'
lengths, checks what it reads against the digest in the header, and joins revisits to the responses
that hold their payload.

Defined cases: a null payload is empty; payloads below ``min_bytes`` are always responses; a
row without an id is a revisit if a row with an id has its payload and else a response; rows
that repeat an original's id and payload are responses too; in URLs blanks, line breaks and what is not ASCII are
percent-encoded, and a page without one is named by its id; an empty table gives an empty result;
other columns are ignored. One record at a time is held decompressed.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import itertools
import string
import urllib.parse
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.util import fields
from barloom.sources.shared import checkpointed, removed, shared_dir

ARCHIVE_BYTES = 32 << 20
#: So many decided headers (about 150 bytes each) are broadcast at most.
BROADCAST_REVISITS = 100_000
#: Bits of a filter of digests at most (16 MB), and the bits that a digest sets.
FILTER_BITS, PROBES = 1 << 27, 4
DECISIONS = ("refers_to", "refers_url", "named", "repeated")
#: Files that are renamed at a time.
RENAMED = 32
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
END = b"\r\n\r\n"
SOFTWARE = b"software: barloom\r\nformat: WARC File Format 1.1\r\n"
NAMES = uuid.uuid5(uuid.NAMESPACE_DNS, "page.barloom")
#: What a URL keeps as it is.
PLAIN = string.punctuation

RECORDS = fields(page_id="long", record_type="string", payload_digest="string", payload_bytes="long", refers_to="long", target="string", intact="boolean")


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1 of a string: its 40-bit pieces as numbers of base 32, in the alphabet of base32."""
    digest = F.sha1(payload.cast("binary"))
    pieces = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*pieces), DIGITS, BASE32)


def decided(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """What to do with which (page_id, payload_digest) of ``heads`` (page_id, url, payload_bytes, payload_digest): only revisits and responses that are there more than once.

    (page_id, payload_digest, refers_to, refers_url, named, repeated): ``named`` if the original has a record id of its own.
    """
    folded = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "page_id").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))
    folded = checkpointed(folded)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "n"))).alias("original")
    originals = checkpointed(folded.groupBy("payload_digest").agg(first, F.sum("n").alias("all")).where("all > 1 and original is not null").drop("all"))
    found = folded.join(originals, "payload_digest")
    repeated, named = F.coalesce(F.col("page_id") == F.col("original.page_id"), F.lit(False)), F.col("original.n") == 1
    kept = found.where(~repeated | (F.col("n") > 1))
    return kept.select(
        "page_id", "payload_digest", F.when(~repeated, F.col("original.page_id")).alias("refers_to"), F.when(~repeated, F.col("original.url")).alias("refers_url"),
        named.alias("named"), repeated.alias("repeated"),
    )


def _numbers(digest: str) -> list[Column]:
    """Two numbers of 40 bits out of a digest in base32."""
    plain = F.translate(digest, BASE32, DIGITS)
    return [F.conv(F.substring(plain, at, 8), 32, 10).cast("long") for at in (1, 9)]


def _places(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(first + k * second) % bits for k in range(PROBES)]


class DigestFilter:
    """A Bloom filter of digests, of at most ``FILTER_BITS`` bits however many there are: beyond that it lets more through."""

    def __init__(self, digests: DataFrame, count: int):
        self.bits = min(FILTER_BITS, 1 << max(16, (10 * count).bit_length()))
        first, second = _numbers("payload_digest")
        places = F.array(*[F.pmod(first + k * second, F.lit(self.bits)) for k in range(PROBES)])
        words = digests.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("bits"))
        self.words = np.zeros(self.bits // 32, np.uint32)
        found = words.toPandas()  # a row for 32 bits of the filter at most
        self.words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)

    def holds(self, spark: SparkSession, digest: str) -> Column:
        """Whether a digest may be among them; false is certain."""
        shared, bits = spark.sparkContext.broadcast(self.words), self.bits

        @F.pandas_udf(T.BooleanType())
        def may(first: pd.Series, second: pd.Series) -> pd.Series:
            places = _places(first.to_numpy(np.int64), second.to_numpy(np.int64), bits)
            return pd.Series(np.logical_and.reduce([(shared.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 for place in places]).astype(bool))

        return may(*_numbers(digest))


def resolve(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url, named, repeated) of every page; revisits have no payload."""
    payload, spark = F.coalesce(html, F.lit("")), pages.sparkSession
    full = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))}
    )
    found = checkpointed(decided(full.drop("payload"), min_bytes))
    count = found.count()
    renamed = found.withColumnsRenamed({"page_id": "id", "payload_digest": "digest"})
    if count <= BROADCAST_REVISITS:
        return _resolved(full, F.broadcast(renamed))
    marked = full.withColumn("__may", DigestFilter(found.select("payload_digest").distinct(), count).holds(spark, "payload_digest"))
    alone = marked.where(~F.col("__may")).drop("__may").withColumns({name: F.lit(None).cast(found.schema[name].dataType) for name in renamed.columns if name in DECISIONS})
    return _resolved(marked.where("__may").drop("__may"), renamed).unionByName(_records(alone))


def _resolved(full: DataFrame, found: DataFrame) -> DataFrame:
    return _records(full.join(found, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left"))


def _records(met: DataFrame) -> DataFrame:
    revisit = F.col("refers_to").isNotNull()
    return met.select(
        "page_id", "url", F.when(~revisit, F.col("payload").cast("binary")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to", "refers_url",
        F.coalesce("named", F.lit(False)).alias("named"), F.coalesce("repeated", F.lit(False)).alias("repeated"),
    )


def _id(page_id: int | None, digest: str) -> str:
    return f"<{(uuid.uuid4() if page_id is None else uuid.uuid5(NAMES, f'{page_id} {digest}')).urn}>"


def _target(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}" if url is None else urllib.parse.quote(url, PLAIN)


def _member(head: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in head.items()], f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + END + block + END, LEVEL, mtime=0)


def _page(row: tuple, date: str) -> bytes:
    page_id, url, payload, size, digest, kind, refers_to, refers_url, named, repeated = row
    head = {"WARC-Type": kind, "WARC-Record-ID": _id(None if repeated else page_id, digest), "WARC-Date": date, "WARC-Target-URI": _target(url, page_id)}
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if kind == "revisit":
        head |= {"WARC-Refers-To": _id(refers_to, digest)} if named else {}
        head |= {"WARC-Refers-To-Target-URI": _target(refers_url, refers_to), "WARC-Refers-To-Date": date, "WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % size
    return _member(head | {"Content-Type": "application/http; msgtype=response"}, http + END + (payload or b""))


#: The text writer ends each row with a zero byte, which is the last of an archive: that of the length of its last member, if it is one of less than 16 MB.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _archives(date: str, archive_bytes: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0

        def done() -> pd.DataFrame:
            whole = b"".join(parts if parts[-1][-1] == 0 else [*parts, EMPTY_MEMBER])
            return pd.DataFrame({"archive": [whole[:-1]]})

        for batch in batches:
            batch = batch.astype({"page_id": "Int64", "refers_to": "Int64"}).astype(object)
            for row in batch.where(batch.notna(), None).itertuples(index=False):
                member = _page(tuple(row), date)
                if parts and size + len(member) > archive_bytes:
                    yield done()
                    parts, size = [], 0
                if not parts:
                    parts.append(_member({"WARC-Type": "warcinfo", "WARC-Record-ID": _id(None, ""), "WARC-Date": date, "Content-Type": "application/warc-fields"}, SOFTWARE))
                parts.append(member)
                size += len(member)
        if parts:
            yield done()

    return pack


def write_archives(records: DataFrame, path: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes resolved pages as ``*.warc.gz`` under ``path``; ``date`` (now, if it is not given) is that of all records."""
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = records.mapInPandas(_archives(date, archive_bytes), fields(archive="binary")).select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    _named(records.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """Gives the files under ``path`` their ending, many at a time, as a store may take long for each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def name(file: str) -> None:
        if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(at, file), spark._jvm.org.apache.hadoop.fs.Path(at, file.removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"{path}/{file} can't be renamed")

    def files() -> Iterator[str]:
        listed = store.listFiles(at, False)
        while listed.hasNext():
            if (file := listed.next().getPath().getName()).endswith(".txt"):
                yield file

    with ThreadPoolExecutor(RENAMED) as pool:
        for some in itertools.batched(files(), 64 * RENAMED):
            list(pool.map(name, some))


def parse(archive: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of one archive's pages as rows of RECORDS, read one after another."""
    number = lambda text: int(text) if text else None
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one is due: {line[:40]!r}")
        head = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key.lower()] = value
        length = int(head["content-length"])
        block = archive.read(length)
        if len(block) != length or archive.read(4) != END:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        if head["warc-type"] == "warcinfo":
            continue
        _, _, payload = block.partition(END)
        told = head["warc-payload-digest"].removeprefix("sha1:")
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        whole = head["warc-type"] == "response"
        yield (
            number(head.get("x-page-id")), head["warc-type"], own if whole else told, len(payload) if whole else None,
            number(head.get("x-refers-to-page-id")), head["warc-target-uri"], own == told if whole else None,
        )


def _read(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in files:
        for content in batch["content"]:
            rows = list(parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))))
            frame = pd.DataFrame(rows, columns=RECORDS.names)
            yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "intact": "boolean"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; digest and size are those of the payload read, if it has one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInPandas(_read, RECORDS)


def joined_revisits(records: DataFrame) -> DataFrame:
    """``records`` with each revisit's payload size taken from the response that holds its payload, and ``intact`` if there is one."""
    revisit = F.col("record_type") == "revisit"
    held = checkpointed(records.where(~revisit & F.col("intact")).groupBy("payload_digest").agg(F.max("payload_bytes").alias("held_bytes")))
    joined = records.where(revisit).join(held, "payload_digest", "left").withColumns({"payload_bytes": F.col("held_bytes"), "intact": F.col("held_bytes").isNotNull()})
    return records.where(~revisit).unionByName(joined.select(records.columns))


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` as deduplicated archives and returns what is read back; without a ``path`` they lie in the shared folder meanwhile."""
    spark = pages.sparkSession
    own = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(pages, min_bytes), own, date, archive_bytes)
    records = checkpointed(read_archives(spark, own))
    if path is None:
        removed(spark, own)
    return joined_revisits(records)


def oracle() -> str:
    """DuckDB SQL of the registered round trip over pages."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
     d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
                  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}',
                      ((('0x' || substr(hex, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM p),
     o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to FROM o"""
