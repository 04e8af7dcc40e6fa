"""SentencePiece encoding through a prefix table, and decoding.

For a merge-type (BPE) model the encoding of a text has one property that makes it linear: the
last token of each prefix's encoding is unique, and it is the one token that ends there and is
compatible with the last token of the prefix before it. Two tokens are compatible if merging
the two of them together gives exactly these two. The encoder walks a text once through an
automaton of all pieces whose states hold the pieces that end there (longest first), stores
for each prefix its last token, and recovers the ids backwards from the end of the table. The
automaton's states and the pairs' compatibility are worked out as texts ask for them.

No piece spans a blank that follows other text, so texts are cut before such blanks, and no
piece holds anything but a letter after a letter, so a cut's trailing punctuation stands
alone. Up to ``REMEMBERED`` cuts with their ids, and as many pairs of tokens, are remembered in
each worker. Characters without a piece become byte tokens.

Defined cases: null and empty texts give the end id alone and decode to ''; texts of any
length take memory in proportion to one text; equal texts give equal results; an empty table
gives an empty result; other columns are ignored. Models must be merge-type with identity
normalisation, a blank put in front and byte fallback; others are refused.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.util import fields

BLANK = "▁"
REMEMBERED = 150_000
#: Rows that a worker encodes before it hands their ids on.
ROWS_AT_ONCE = 1000
#: Longer cuts are not remembered.
LONGEST = 64
NORMAL, BYTE = 1, 6
#: Where a token would be: before the first character, and for a character without a piece.
START, NO_PIECE = -2, -1
ANY_LEFT = {START: True, NO_PIECE: True}
MATCHES, SEEN = 0, 1

DIGEST = fields(n_tokens="long", ids_sha256="string", decoded_sha256="string")


class PrefixEncoder:
    """Encodes texts with one model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        normalizer = model.normalizer_spec
        sound = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not normalizer.precompiled_charsmap
        if not sound or not normalizer.add_dummy_prefix or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("a merge-type model with identity normalisation and byte fallback is needed")
        self.pieces = [piece.piece for piece in model.pieces]
        self.ids = {piece.piece: i for i, piece in enumerate(model.pieces) if piece.type == NORMAL}
        self.rank = {piece: at for at, piece in enumerate(sorted(self.ids, key=lambda piece: -model.pieces[self.ids[piece]].score))}
        self.bytes = [0] * 256
        for i, piece in enumerate(model.pieces):
            if piece.type == BYTE:
                self.bytes[int(piece.piece[1:-1], 16)] = i
        self.end = next(i for i, piece in enumerate(model.pieces) if piece.piece == "</s>")
        if any(BLANK in piece[1:] and piece.strip(BLANK) for piece in self.ids):
            raise ValueError("pieces that hold a blank after other characters are not supported")
        self.tails_alone = not any(a.isalpha() and not b.isalpha() for piece in self.ids for a, b in zip(piece, piece[1:], strict=False))
        self.lines_alone = not any("\n" in piece for piece in self.ids if len(piece) > 1)
        # a token ends a prefix only if its own text encodes to itself; with each, by left neighbour, whether the two fit
        self.halves: dict[str, list[str]] = {}
        self.whole: dict[str, tuple[int, int, dict[int, bool]]] = {}
        for piece, token in self.ids.items():
            if len(parts := self.parts(piece, 2)) <= 2:
                self.halves[piece] = parts
                self.whole[piece] = (len(piece), token, dict(ANY_LEFT))
        self.prefixes = {piece[:k] for piece in self.whole for k in range(1, len(piece) + 1)}
        self.states: dict[str, dict] = {}
        self.root = self.state("")
        self.runs = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.remembered: dict[str, tuple[int, ...]] = {"": ()}
        self.pairs = 0

    def parts(self, text: str, least: int = 1) -> list[str]:
        """A short text's parts after merging best-scored neighbours, leftmost first, down to ``least`` parts."""
        rank, parts = self.rank, list(text)
        pairs = [rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > least and (best := min(pairs)) != math.inf:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank.get(parts[at - 1] + parts[at], math.inf)
            if at < len(pairs):
                pairs[at] = rank.get(parts[at] + parts[at + 1], math.inf)
        return parts

    @lru_cache(maxsize=1 << 15)  # noqa: B019  one encoder lives as long as its worker
    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts at one side of a piece as it is merged, smallest first, each with the rank of the merge that ends it."""
        out: list[tuple[str, float]] = [(piece, math.inf)]
        while len(piece) > 1:
            out.append((self.halves[piece][side], self.rank[piece]))
            piece = out[-1][0]
        return out[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are when their texts are merged together.

        Only a merge across their border could change them: it happens if its rank comes before
        those of the merges that end the parts at the border (on equal ranks the leftmost is first).
        """
        ours, theirs, i, j = self.edge(self.pieces[left], 1), self.edge(self.pieces[right], 0), 0, 0
        while True:
            (a, ends_a), (b, ends_b) = ours[i], theirs[j]
            across = self.rank.get(a + b, math.inf)
            if across < ends_a and across <= ends_b and across != math.inf:
                return False
            if ends_a == ends_b == math.inf:
                return True
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1

    def state(self, seen: str) -> dict:
        """The automaton's state for the longest end of the text that begins a piece."""
        if seen not in self.states:
            ends = (seen[k:] for k in range(len(seen)))
            self.states[seen] = {MATCHES: tuple(self.whole[end] for end in ends if end in self.whole), SEEN: seen}
        return self.states[seen]

    def step(self, state: dict, char: str) -> dict:
        """The state after one more character; the automaton keeps it."""
        seen = state[SEEN] + char
        while seen and seen not in self.prefixes:
            seen = seen[1:]
        state[char] = self.state(seen)
        return state[char]

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """For each prefix of ``text``, the empty one included, the id of its last token and that token's length."""
        tokens, lengths, state = [START], [0], self.root
        for at, char in enumerate(text, 1):
            try:
                state = state[char]
            except KeyError:
                state = self.step(state, char)
            for length, token, fit in state[MATCHES]:
                left = tokens[at - length]
                try:
                    fitting = fit[left]
                except KeyError:
                    fitting = fit[left] = self.fits(left, token)
                    self.pairs += 1
                if fitting:
                    break
            else:
                length, token = 1, NO_PIECE
            tokens.append(token)
            lengths.append(length)
        return tokens, lengths

    def recovered(self, text: str) -> tuple[int, ...]:
        """The ids of one text, recovered backwards from its prefix table."""
        if self.pairs >= REMEMBERED:
            self.pairs = 0
            for _, _, fit in self.whole.values():
                fit.clear()
                fit.update(ANY_LEFT)
        tokens, lengths = self.prefix_table(text)
        at, back = len(text), []
        while at:
            token = tokens[at]
            back += [token] if token >= 0 else [self.bytes[b] for b in reversed(text[at - 1].encode())]
            at -= lengths[at]
        back.reverse()
        return tuple(back)

    def cut_ids(self, cut: str) -> tuple[int, ...]:
        """The ids of one cut, which is remembered."""
        ids = None
        if self.tails_alone and not cut[-1].isalpha():
            at = next((k for k in range(len(cut) - 1, 0, -1) if cut[k - 1].isalpha()), 0)
            if at:
                ids = tuple(i for part in (cut[:at], cut[at:]) for i in (self.remembered.get(part) or self.cut_ids(part)))
        ids = ids or self.recovered(cut)
        if len(cut) <= LONGEST:
            if len(self.remembered) >= REMEMBERED:
                self.remembered = {"": ()}
            self.remembered[cut] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without an end id."""
        if not text:
            return []
        blanks = BLANK + text.replace(" ", BLANK)
        if BLANK + BLANK in blanks or "\0" in blanks:
            cuts = self.runs.findall(blanks)
        else:  # the same cuts by plain string operations, and line ends apart, which no piece joins to other characters
            marked = blanks.replace(BLANK, "\0" + BLANK)
            cuts = (marked.replace("\n", "\0\n\0") if self.lines_alone else marked).split("\0")
        out: list[int] = []
        for cut in cuts:
            ids = self.remembered.get(cut)
            out += self.cut_ids(cut) if ids is None else ids
        return out


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PrefixEncoder:
    return PrefixEncoder(model_file)


@lru_cache(maxsize=2)
def library(model_file: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def encoded(model_file: str):
    """A column function: the ids of each text, with the end id."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(model_file)
        for batch in texts:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                yield batch.iloc[at : at + ROWS_AT_ONCE].map(lambda text: np.array([*own.encode(text or ""), own.end], np.int32))

    return ids


def decoded(model_file: str):
    """A column function: the text that each array of ids decodes to (null: null)."""

    @F.pandas_udf(T.StringType())
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = library(model_file)
        for batch in ids:
            yield batch.map(lambda row: None if row is None else own.decode(row.tolist()))

    return text


def digests(model_file: str):
    """A column function: DIGEST of each text's ids and of the text they decode to."""

    @F.pandas_udf(DIGEST)
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, back = encoder(model_file), library(model_file)
        named = [str(i) for i in range(len(own.pieces))]
        for batch in texts:
            rows = []
            for text in batch:
                ids = [*own.encode(text or ""), own.end]
                listed, decoded_text = " ".join([named[i] for i in ids]), back.decode(ids)
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded_text.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=DIGEST.names)

    return digest


def token_digests(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    return docs.select(F.col(doc_id).alias("doc_id"), digests(model_file)(F.col(text)).alias("made")).select("doc_id", "made.*")
