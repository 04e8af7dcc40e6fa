import random
import re

import pytest
import xxhash

from barloom.llm import components, simhash
from barloom.llm.queries import op10_simhash


def brute_fingerprint(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def union_find(nodes: list, links: list[tuple]) -> dict:
    root = {node: node for node in nodes}

    def top(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {node: top(node) for node in nodes}


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    return union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(prints[a] ^ prints[b]).count("1") <= 3])


def test_query_against_all_pairs(spark, sf_dir):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_simhash(spark, sf_dir).collect()
    prints = {i: brute_fingerprint(text) for i, text in texts.items()}
    assert {row["doc_id"]: row["fingerprint"] for row in rows} == {i: f"{fp:016x}" for i, fp in prints.items()}
    assert {row["doc_id"]: row["component_id"] for row in rows} == brute_components(prints)


@pytest.mark.parametrize("crowd", [1000, 2])
def test_links_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    prints: set[int] = {0, (1 << 64) - 1, 7}
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(12):
            prints.add(at)
            for _ in range(rng.randrange(1, 6)):
                at ^= 1 << rng.randrange(64)
    signed = {fp - (1 << 64) if fp >> 63 else fp for fp in prints}
    found = simhash.hamming_links(spark.createDataFrame([(fp,) for fp in signed], "fp long")).collect()
    pairs = [tuple(row) for row in found]
    ordered = sorted(signed)
    want = {(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_components_of_chains_and_random_links(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(5, 5), (9, None), (200, 100)]
    found = components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    whole = [(a, b) for a, b in links if b is not None and a != b]
    assert {row["node"]: row["component"] for row in found} == union_find(sorted({x for link in whole for x in link}), whole)


def test_odd_documents(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    groups = {row["doc_id"]: row["component_id"] for row in rows}
    assert groups[2] == groups[3] == groups[7] == 2 and groups[8] == groups[9] == 8 and groups[1] == 1
    assert {row["fp"] for row in rows if row["doc_id"] in (2, 3, 7)} == {0}
    assert simhash.near_duplicates(no_documents).collect() == []


def test_one_of_each(odd_documents, no_documents):
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(row["doc_id"] or 0 for row in kept.collect()) == [0, 1, 2, 4, 5, 6, 8]
    assert simhash.one_of_each(no_documents).collect() == []
