import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from barloom.llm import bytepairs

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytepairs.read_ranks(RANKS), special_tokens={})


def test_random_texts_equal_the_library(library):
    """Few letters (ties), contractions, blanks of all kinds, many scripts, characters that the two pattern libraries take for different kinds, and any code points."""
    own, rng = bytepairs.codec(RANKS, PATTERN), random.Random(1)
    anywhere = [chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(3000)]
    pools = ["ab", "abc'stdmlrev ", "  \t\n\r\x0b\x1c\x85 　ax1", "naïveßé日本語😀́ͅ", [*map(chr, bytepairs.stand_ins()), *"a1 '#"], anywhere]
    for k in range(3000):
        text = "".join(rng.choice(pools[k % len(pools)]) for _ in range(rng.randrange(120)))
        assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode(), text


@pytest.mark.parametrize("text", ["a" * 20_000, "etaoin" * 5000, " " * 9999 + "x", "!?" * 8000, "'s't're 've", "<|endoftext|>", "a\n\n  b \n"])
def test_long_cuts_and_odd_texts(library, text):
    assert bytepairs.codec(RANKS, PATTERN).encode(text) == library.encode_ordinary(text)


def test_segment_tree_against_min():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 8, 33):
        values = [rng.randrange(50) for _ in range(n)]
        tree = bytepairs.SegmentTree([*values])
        for _ in range(100):
            at, value = rng.randrange(n), rng.choice((rng.randrange(50), bytepairs.NO_PAIR))
            values[at] = value
            tree.change(at, value)
            assert tree.nodes[1] == min(values)


def test_long_cuts_take_few_steps(monkeypatch):
    """Changes of nodes grow as n log n."""
    steps = []
    original = bytepairs.SegmentTree.change
    monkeypatch.setattr(bytepairs.SegmentTree, "change", lambda self, at, value: (steps.append(1), original(self, at, value))[1])
    bytepairs.codec(RANKS, PATTERN).merged(b"etaoinshrdlu" * 4000)
    assert len(steps) < 3 * 48_000


def test_what_is_remembered_changes_nothing(monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBERED", 3)
    own, text = bytepairs.BytePairs(RANKS, PATTERN), "some words and some more words " * 5
    assert own.encode(text) == bytepairs.codec(RANKS, PATTERN).encode(text) and len(own.remembered) <= 3


def test_rows(spark, sf_dir, library, odd_documents, no_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    texts = [(row["doc_id"], row["text"] or "") for row in docs.collect()]
    want = []
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(row)) for row in bytepairs.token_digests(docs, RANKS, PATTERN).collect())
    assert bytepairs.token_digests(no_documents, RANKS, PATTERN).collect() == []
    assert bytepairs.token_digests(odd_documents, RANKS, PATTERN).count() == odd_documents.count()


def test_ids_and_bytes_as_columns(spark):
    docs = spark.createDataFrame([("a b 😀",), (None,), ("",)], "text string")
    made = docs.withColumn("ids", bytepairs.encoded(RANKS, PATTERN)(F.col("text"))).withColumn("back", bytepairs.decoded(RANKS, PATTERN)(F.col("ids")))
    assert [(row["back"].decode(), len(row["ids"]) > 0) for row in made.collect()] == [("a b 😀", True), ("", False), ("", False)]
    assert made.select(bytepairs.decoded(RANKS, PATTERN)(F.lit(None).cast("array<int>"))).first()[0] is None
