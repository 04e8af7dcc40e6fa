"""Byte-level byte pair encoding with a segment tree over byte positions, and decoding.

A text is cut by the vocabulary's pattern, and each cut is encoded by itself. A cut that is a token is that token.
In any other the pair of neighbours with the lowest rank is merged, the leftmost of equal ones, until no
neighbours make a token. Leaf ``i`` of a segment tree holds the rank of what starts at byte ``i`` with its right neighbour,
and the position, so the root is the leftmost lowest pair; a merge changes three leaves (its own, its
right neighbour's, which goes, and its left neighbour's), each with its way to the root. A cut of n bytes
takes n log n steps, however long it is.

Texts are split by Spark. A worker remembers the ids of short cuts, and works out those that it meets for the first time many at once:
their trees are rows of one matrix, and a step merges one pair in each.

Defined cases: a null text is empty; an empty text has no tokens; special tokens' names in a text are ordinary text; a byte that
the vocabulary doesn't have is refused with an error; equal texts have equal ids; rows keep their number and
other columns are ignored; an empty table gives an empty result. What counts as letter, number or blank is asked of the
installed tokenizer library itself, as its Unicode version is another than that of Python's pattern library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.util import fields

#: Cuts that a worker remembers from one batch to the next, and the characters that one of these has at most.
REMEMBERED, LONGEST = 400_000, 64
#: Rows, and characters of them, that go through a worker's lists at once.
ROWS_AT_ONCE, LETTERS_AT_ONCE = 1024, 1 << 21
#: Leaves of the trees that are rows of one matrix, and rows of such a matrix at most.
LEAVES, AT_ONCE = (8, 16, 32, 64), 4096
#: Fewer cuts than this are worked out one by one.
TOGETHER = 256
#: The bits of a position in a leaf, and a leaf without a pair.
BITS = 36
POSITION, NO_PAIR = (1 << BITS) - 1, 1 << 62

DIGEST = fields(n_tokens="long", ids_sha256="string", decoded_sha256="string")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids: a line each of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: A character of each kind that means nothing else in a pattern of cuts.
STAND_INS = {r"\p{L}": "x", r"\p{N}": "0", r"\s": " "}
NO_KIND = "#"


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Characters that the tokenizer library takes for another kind than Python's patterns do, each with one of its kind."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    found: dict[int, str] = {}
    for kind, shown in STAND_INS.items():
        library = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs, ours = {*library.decode(library.encode_ordinary(every))}, {*regex.findall(kind, every)}
        found |= {ord(c): found.get(ord(c), NO_KIND) for c in ours - theirs} | {ord(c): shown for c in theirs - ours}
    return found


class SegmentTree:
    """The lowest of ``values``, which is ``nodes[1]``, kept under changes of single ones."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.nodes = [NO_PAIR] * self.size + values + [NO_PAIR] * (self.size - len(values))
        nodes = self.nodes
        for at in range(self.size - 1, 0, -1):
            left, right = nodes[2 * at], nodes[2 * at + 1]
            nodes[at] = left if left < right else right

    def change(self, at: int, value: int) -> None:
        """Goes up until a node stays what it was."""
        nodes, at = self.nodes, at + self.size
        if nodes[at] == value:
            return
        nodes[at] = value
        while at > 1:
            other = nodes[at ^ 1]
            low = value if value < other else other
            at >>= 1
            if nodes[at] == low:
                return
            nodes[at] = value = low


class BytePairs:
    """Encoding and decoding by one vocabulary."""

    def __init__(self, ranks_file: str, pattern: str):
        self.ranks = read_ranks(ranks_file)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.cuts = regex.compile(pattern)
        self.table = stand_ins()
        self.odd, lowest = {*map(chr, self.table)}, min(self.table, default=0x10FFFF)
        self.high = regex.compile(f"[{chr(lowest)}-{chr(0x10FFFF)}]")
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        splits = ((self.ranks.get(token[:at]), self.ranks.get(token[at:]), rank) for token, rank in self.ranks.items() for at in range(1, len(token)))
        table = np.array([(a << 32 | b, rank) for a, b, rank in splits if a is not None and b is not None] or [(-1, 0)], np.int64)
        self.pairs, self.pair_ranks = table[np.argsort(table[:, 0])].T.copy()  # every two tokens that make one

    def cut(self, text: str) -> list[str]:
        """The cuts of a text."""
        if text.isascii() or not self.high.search(text) or self.odd.isdisjoint(text):
            return self.cuts.findall(text)
        return [text[found.start() : found.end()] for found in self.cuts.finditer(text.translate(self.table))]

    def merged(self, data: bytes) -> list[int]:
        """The ids of one cut's bytes."""
        ranks, n, longest = self.ranks, len(data), self.longest
        whole = ranks.get(data)
        if whole is not None:
            return [whole]

        def pair(start: int, end: int) -> int:
            """The leaf of what starts at ``start`` and with its right neighbour reaches to ``end``."""
            rank = ranks.get(data[start:end]) if end - start <= longest else None
            return NO_PAIR if rank is None else rank << BITS | start

        tree = SegmentTree([*[pair(at, at + 2) for at in range(n - 1)], NO_PAIR])
        nodes, change, after, before = tree.nodes, tree.change, [*range(1, n + 1)], [*range(-1, n - 1)]
        while (low := nodes[1]) < NO_PAIR:
            at = low & POSITION
            gone, left = after[at], before[at]
            after[at] = then = after[gone]
            change(gone, NO_PAIR)
            if then < n:
                before[then] = at
                change(at, pair(at, after[then]))
            else:
                change(at, NO_PAIR)
            if left >= 0:
                change(left, pair(left, then))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[data[at : after[at]]])
            at = after[at]
        return ids

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of neighbouring ids, or ``NO_PAIR``."""
        keys = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[place] == keys, self.pair_ranks[place], NO_PAIR)

    def merged_together(self, cuts: list[bytes], size: int) -> list[tuple[int, ...]]:
        """The ids of cuts of at most ``size`` bytes (a power of two): row by row a segment tree, a merge a step in each."""
        n, lengths = len(cuts), np.array([len(cut) for cut in cuts])
        every, inside = np.arange(n), np.arange(size) < lengths[:, None]
        padded = np.frombuffer(b"".join(cut.ljust(size, b"\0") for cut in cuts), np.uint8).reshape(n, size)
        ids = np.where(inside, self.single[padded], -1)
        if (ids[inside] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        nodes, places = np.full((n, 2 * size), NO_PAIR, np.int64), np.arange(size - 1)
        ranks = self.found(ids[:, :-1], ids[:, 1:])
        nodes[:, size:-1] = np.where((ranks < NO_PAIR) & inside[:, 1:], ranks << BITS | places, NO_PAIR)
        for at in range(size - 1, 0, -1):
            nodes[:, at] = np.minimum(nodes[:, 2 * at], nodes[:, 2 * at + 1])
        after, before = np.tile(np.arange(1, size + 1), (n, 1)), np.tile(np.arange(-1, size), (n, 1))
        live = inside.copy()
        while len(rows := every[nodes[every, 1] < NO_PAIR]):
            every, lowest = rows, nodes[rows, 1]
            at = lowest & POSITION
            gone = after[rows, at]
            then, left = after[rows, gone], before[rows, at]
            after[rows, at], before[rows, then], ids[rows, at], live[rows, gone] = then, at, lowest >> BITS, False
            ranks = self.found(ids[rows, at], ids[rows, np.minimum(then, size - 1)])
            own = np.where((then < lengths[rows]) & (ranks < NO_PAIR), ranks << BITS | at, NO_PAIR)
            ranks = self.found(ids[rows, left], ids[rows, at])
            theirs = np.where((left >= 0) & (ranks < NO_PAIR), ranks << BITS | left, NO_PAIR)
            for place, value in ((gone, NO_PAIR), (at, own), (np.where(left < 0, gone, left), theirs)):
                node = place + size
                nodes[rows, node] = value
                for _ in range(size.bit_length() - 1):
                    node = node >> 1
                    nodes[rows, node] = np.minimum(nodes[rows, 2 * node], nodes[rows, 2 * node + 1])
        ends = np.cumsum(live.sum(axis=1)).tolist()
        flat = ids[live].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learned(self, cuts: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of cuts that aren't remembered."""
        out, groups = {}, {size: ([], []) for size in LEAVES}
        for cut in cuts:
            data = cut.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[cut] = (whole,)
            elif len(data) > LEAVES[-1]:
                out[cut] = tuple(self.merged(data))
            else:
                names, bytes_of = groups[next(size for size in LEAVES if len(data) <= size)]
                names.append(cut)
                bytes_of.append(data)
        for size, (names, bytes_of) in groups.items():
            if len(names) < TOGETHER:
                out |= {name: tuple(self.merged(data)) for name, data in zip(names, bytes_of, strict=True)}
                continue
            for at in range(0, len(names), AT_ONCE):
                out |= zip(names[at : at + AT_ONCE], self.merged_together(bytes_of[at : at + AT_ONCE], size), strict=True)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts."""
        cuts = [self.cut(text) for text in texts]
        missing, known, out = set().union(*cuts).difference(self.remembered), self.remembered, []
        if missing:
            known |= self.learned(missing)
        for some in cuts:
            ids: list[int] = []
            for cut in some:
                ids += known[cut]
            out.append(ids)
        for cut in missing:
            if len(cut) > LONGEST:
                del known[cut]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; those of a part of a text need not be whole characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def codec(ranks_file: str, pattern: str) -> BytePairs:
    return BytePairs(ranks_file, pattern)


def _some(texts: pd.Series) -> Iterator[list[str]]:
    """A few texts at a time; null ones are empty."""
    some, letters = [], 0
    for text in texts:
        some.append(text or "")
        letters += len(some[-1])
        if len(some) >= ROWS_AT_ONCE or letters >= LETTERS_AT_ONCE:
            yield some
            some, letters = [], 0
    if some:
        yield some


def encoded(ranks_file: str, pattern: str):
    """A column function: the ids of each text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_file, pattern)
        for batch in texts:
            yield pd.Series([np.array(ids, np.int32) for some in _some(batch) for ids in own.encode_all(some)], dtype=object)

    return ids


def decoded(ranks_file: str, pattern: str):
    """A column function: the bytes that each array of ids decodes to (null: null)."""

    @F.pandas_udf(T.BinaryType())
    def data(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_file, pattern)
        for batch in ids:
            yield batch.map(lambda row: None if row is None else own.decode(row.tolist()))

    return data


def digests(ranks_file: str, pattern: str):
    """A column function: DIGEST of each text's ids and of the bytes they decode to."""

    @F.pandas_udf(DIGEST)
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_file, pattern)
        named = {rank: str(rank) for rank in own.tokens}
        for batch in texts:
            rows = []
            for some in _some(batch):
                for ids in own.encode_all(some):
                    listed = " ".join([named[i] for i in ids])
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=DIGEST.names)

    return digest


def token_digests(docs: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    return docs.select(F.col(doc_id).alias("doc_id"), digests(ranks_file, pattern)(F.col(text)).alias("made")).select("doc_id", "made.*")
