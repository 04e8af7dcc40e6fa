"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled sample text recognises every substring of the
sample. A text is cross-parsed against each: the longest match from the current place is one
phrase, then parsing goes on behind it. A language's code length is its number of phrases
times log2 of its sample's length (bits per phrase); over the text's length that is the
cross-parsing entropy. The language with the fewest normalised phrases, so the shortest code,
wins, and the score is its share of the languages' probabilities 2 ** -bits.

Texts are seen as lower-case letters with one blank for each run of other characters. A
segment of ``SEGMENT`` characters is parsed on its own, all segments of a text add up, and
many segments are parsed side by side as one array, a character at a time.

The sample takes documents in the order of a hash of their ids until a language has
``SAMPLE_CHARS`` characters (less if the languages' samples together would pass ``TOTAL_CHARS``) or
``SAMPLE_DOCS`` documents. Documents are taken whole, only of one longer than ``DOC_CHARS`` characters so many are, in
parts spread evenly over it. Which hashes a language needs follows from counts over all rows, so
that a bounded number of rows is ever gathered, on however many machines: about three times the
sample. Everything else works on all rows.

Every letter of a sample has a class of its own, however many scripts there are. While all letters
fit ``CLASSES`` the automata are dense tables; else each is a sorted list of its transitions.

Defined cases: null ids, texts and languages teach nothing; of rows that share an id and language one
text is learned from (the smallest); a text that is null or has no
letter is ``und`` with score 0, and so is every text if no language was learned; equal texts
give equal results and equal code lengths go to the language that sorts first; letters unknown
to a language are phrases of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.util import broadcast_up_to, fields, hash_number, id_remainder, whole_or_pieces
from barloom.sources.shared import checkpointed

SAMPLE_CHARS, TOTAL_CHARS = 24_000, 1_600_000
#: Documents of a language's sample at most, and characters of one.
SAMPLE_DOCS, DOC_CHARS = 400, 6_000
#: So many languages are broadcast at most.
BROADCAST_ROWS = 50_000
#: Bits of the hash that orders documents.
ORDER_BITS = 60
SEGMENT = 256
#: Segments that are parsed side by side.
ABREAST = 4096
#: Classes of characters: the end of a segment, a letter outside the alphabet, a blank, then the alphabet.
END, OTHER, BLANK, FIRST = 0, 1, 2, 3
#: Classes of a dense table.
CLASSES = 128
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"

PREDICTION = fields(lang_pred="string", score="double", entropy="double")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a string of classes; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in follow[at]:
            follow[at][code] = new
            at = link[at]
        if at >= 0:
            target = follow[at][code]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and follow[at].get(code) == target:
                    follow[at][code] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return follow


@lru_cache(maxsize=4)
def character_classes(alphabet: str) -> np.ndarray:
    """The class of every code point."""
    known = {char: FIRST + k for k, char in enumerate(alphabet)}
    classes = np.full(0x110000, BLANK, np.min_scalar_type(FIRST + len(alphabet)))
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            classes[point] = known.get(char.lower()[0], OTHER)
    return classes


def classified(text: str, alphabet: str) -> np.ndarray:
    """A text's classes, with one blank for each run of characters that aren't letters; empty if there is no letter."""
    codes = character_classes(alphabet)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == BLANK
    if blank.all():
        return codes[:0]
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


class CrossParser:
    """Languages' suffix automata; ``phrases`` counts a text's phrases against each."""

    def __init__(self, samples: dict[str, list[str]]):
        self.alphabet = "".join(sorted({char for texts in samples.values() for text in texts for char in text.lower() if char.isalpha()}))
        self.languages = sorted(samples)
        self.bits, self.edges = [], []
        for language in self.languages:
            sample = [code for text in samples[language] for code in [*classified(text, self.alphabet).tolist(), OTHER]]
            automaton = suffix_automaton(sample)
            arcs = np.array([(state, code, to) for state, follow in enumerate(automaton) for code, to in follow.items() if code != OTHER], np.int32)
            self.bits.append(math.log2(max(2, len(sample))))
            self.edges.append((len(automaton), arcs.reshape(-1, 3)))

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name not in ("table", "arcs")}  # each worker makes its own

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """What follows on each (state, class): four times the next state's place, plus the phrases that end on the way; and the starts."""
        parts, starts, base = [], [], 0
        for states, arcs in self.edges:
            start = base
            part = np.empty((states, CLASSES), np.int32)
            # no way on: the open phrase ends, and the character opens the next or, if the language lacks it, is one by itself
            fresh = np.full(CLASSES, start * 4 + 2, np.int32)
            opening = arcs[arcs[:, 0] == 0]
            fresh[opening[:, 1]] = (base + opening[:, 2] * CLASSES) * 4 + 1
            fresh[END] = start * 4 + 1
            part[:] = fresh
            part[0] = fresh - 1  # at the start no phrase is open
            part[arcs[:, 0], arcs[:, 1]] = (base + arcs[:, 2] * CLASSES) * 4
            parts.append(part.ravel())
            starts.append(start)
            base += states * CLASSES
        return np.concatenate(parts), np.array(starts, np.int32)

    def phrases(self, segments: np.ndarray) -> np.ndarray:
        """(language, segment): the phrases of each row of classes, all of one length."""
        if FIRST + len(self.alphabet) > CLASSES:
            return self._sparse_phrases(segments)
        table, starts = self.table
        steps = np.ascontiguousarray(segments.T).astype(np.int32)
        value = np.repeat(starts[:, None] * 4, len(segments), axis=1)
        count = np.zeros(value.shape, np.int32)
        for step in [*steps, np.full(len(segments), END, np.int32)]:
            value = table.take((value >> 2) + step)
            count += value & 3
        return count

    @cached_property
    def arcs(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each language the sorted (state, class) that have a way on, as one number, the next states, and the next states from the start by class."""
        classes, made = FIRST + len(self.alphabet), []
        for _, arcs in self.edges:
            keys = arcs[:, 0].astype(np.int64) * classes + arcs[:, 1]
            order = keys.argsort()
            opening = np.zeros(classes, np.int32)
            first = arcs[arcs[:, 0] == 0]
            opening[first[:, 1]] = first[:, 2]
            made.append((np.append(keys[order], -1), np.append(arcs[order, 2], 0), opening))
        return made

    def _sparse_phrases(self, segments: np.ndarray) -> np.ndarray:
        """``phrases`` by search in the sorted transitions."""
        classes, count = FIRST + len(self.alphabet), np.zeros((len(self.languages), len(segments)), np.int32)
        steps = np.vstack([segments.T.astype(np.int64), np.full((1, len(segments)), END, np.int64)])
        for (keys, follow, opening), counted in zip(self.arcs, count, strict=True):
            state = np.zeros(len(segments), np.int32)
            for step in steps:
                key = state * np.int64(classes) + step
                at = np.searchsorted(keys[:-1], key)
                known, fresh = keys[at] == key, opening[step]
                counted += ~known * ((state > 0) + ((fresh == 0) & (step != END)).astype(np.int32))
                state = np.where(known, follow[at], fresh)
        return count

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """The prediction for each text."""
        total = np.zeros((len(self.languages), len(texts)))
        lengths = np.zeros(len(texts), np.int64)
        waiting, owners, rows = [], [], 0

        def parse() -> None:
            owner = np.concatenate(owners)
            for counted, found in zip(total, self.phrases(np.concatenate(waiting)), strict=True):
                counted += np.bincount(owner, found, len(texts))

        for at, text in enumerate(texts):
            codes = classified(text, self.alphabet) if text and self.languages else np.empty(0, np.uint8)
            lengths[at] = len(codes)
            for place in range(0, len(codes), SEGMENT * ABREAST):
                part = codes[place : place + SEGMENT * ABREAST]
                cut = np.pad(part, (0, -len(part) % SEGMENT), constant_values=END).reshape(-1, SEGMENT)
                waiting.append(cut)
                owners.append(np.full(len(cut), at))
                rows += len(cut)
                if rows >= ABREAST:
                    parse()
                    waiting, owners, rows = [], [], 0
        if rows:
            parse()
        bits = total * np.array(self.bits).reshape(-1, 1)
        return pd.DataFrame([self._decided(bits[:, at], int(length)) for at, length in enumerate(lengths)], columns=PREDICTION.names)

    def _decided(self, bits: np.ndarray, length: int) -> tuple[str, float, float | None]:
        if not length:
            return UNDETERMINED, 0.0, None
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(bits[best] - bits).sum()), float(bits[best] / length)


def labelled_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Texts by language from the rows of the learning folds, in the order of a hash of their ids, up to the documented bounds."""
    order = hash_number(F.col(doc_id).cast("string"), ORDER_BITS // 4)
    learning = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0) & (id_remainder(doc_id, FOLDS) != HELD_OUT)).select(
        F.col(lang).alias("lang"), order.alias("order"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.least(F.length(text), F.lit(DOC_CHARS)).alias("chars")
    )
    counts = checkpointed(learning.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"), F.avg("chars").alias("chars")))
    share = min(SAMPLE_CHARS, TOTAL_CHARS // max(1, counts.count()))
    # three times the documents that the share takes, and some, as lengths vary
    needed = F.least(F.lit(SAMPLE_DOCS), F.lit(3 * share) / F.col("chars") + 30)
    least = counts.select("lang", (F.least(F.lit(1.0), needed * 1.2 / F.col("ids")) * float(1 << ORDER_BITS)).alias("below"))
    near = learning.join(broadcast_up_to(least, BROADCAST_ROWS), "lang").where(F.col("order") < F.col("below"))
    rows = near.groupBy("lang", "id", "order").agg(F.min(whole_or_pieces("text", DOC_CHARS)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["order"], r["id"])):
        if taken.get(row["lang"], 0) < share and len(samples.get(row["lang"], [])) < SAMPLE_DOCS:
            samples.setdefault(row["lang"], []).append(row["text"])
            taken[row["lang"]] = taken.get(row["lang"], 0) + len(row["text"])
    return samples


def predicted(model: CrossParser, docs: DataFrame, text: str = "text") -> Column:
    """A struct column (lang_pred, score, entropy) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield shared.value.predict(batch)

    return predict(F.col(text))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy) of every row of ``docs``, learned from its own labelled rows."""
    model = CrossParser(labelled_sample(docs, doc_id, text, lang))
    held_out = F.coalesce(id_remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), predicted(model, docs, text).alias("made")).select(
        "doc_id", "held_out", "made.*"
    )
