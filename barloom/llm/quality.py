"""A quality classifier by compression with zstandard dictionaries.

Two dictionaries are trained, one on good and one on bad labelled text. A text is compressed
in blocks of ``BLOCK`` bytes (so that a long text doesn't outgrow its dictionary) with each,
and the difference of the two compressed sizes over the text's size says which kind it is more
like. A logistic curve turns the normalised difference, beside the normalised size itself
(repetitive text is small either way), into a probability of label 1. It is fitted on labelled
rows that trained no dictionary.

The labelled rows that are learned from are a bounded sample: up to ``ROWS`` documents of each
label, the first in the order of a hash of their ids. They are learned from whole; only of one
longer than ``TEXT_CHARS`` characters so many are taken, in parts spread evenly over it. All texts
are scored whole.

Defined cases: rows with a null id or label teach nothing, and a document labelled both ways
counts as label 0; of rows that share an id one text is learned from (the smallest); a null text is scored like an empty one, whose features are 0; equal texts
give equal scores; if either label is missing, every score is the labels' mean (0.5 if there are
none); an empty table gives an empty result; other columns are kept, and those named like the
results (parameters) are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.util import fields, hash_number, id_remainder, whole_or_pieces

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
ROWS, TEXT_CHARS = 1500, 16_384
DICTIONARY, LEVEL, BLOCK, TRAINING_BLOCK = 32_768, 3, 1024, 512
#: Every so many-th of a label's rows fits the curve instead of a dictionary.
CURVE_SHARE = 3
STEPS, RIDGE = 40, 1e-3

SCORES = fields(difference="double", ratio="double")


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on blocks of texts; the texts themselves where they are too few to train one."""
    blocks = [text[at : at + TRAINING_BLOCK] for text in texts for at in range(0, len(text), TRAINING_BLOCK)]
    random.Random(0).shuffle(blocks)
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY] or b"\0" * 8


class Compressors:
    """The two dictionaries, and a text's features from them."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.dictionaries = _dictionary(good), _dictionary(bad)
        self._made: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_made": None}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._made is None:
            made = [zstandard.ZstdCompressionDict(data) for data in self.dictionaries]
            for dictionary in made:
                dictionary.precompute_compress(level=LEVEL)
            self._made = [zstandard.ZstdCompressor(LEVEL, dictionary, write_checksum=False, write_content_size=False, write_dict_id=False) for dictionary in made]
        return self._made

    def features(self, text: bytes) -> tuple[float, float]:
        """(bad minus good compressed bytes, mean compressed bytes), each over the text's bytes."""
        if not text:
            return 0.0, 0.0
        blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        good, bad = (sum(map(len, map(made.compress, blocks))) for made in self.compressors())
        return (bad - good) / len(text), (bad + good) / 2 / len(text)


class Curve:
    """Logistic regression on standardised terms of the features, by Newton's method."""

    def __init__(self, features: np.ndarray, labels: np.ndarray):
        terms = self.terms(features)
        self.mean, self.scale = terms.mean(axis=0), np.maximum(terms.std(axis=0), 1e-9)
        inputs = np.column_stack([(terms - self.mean) / self.scale, np.ones(len(terms))])
        weights, ridge = np.zeros(inputs.shape[1]), RIDGE * len(labels) * np.diag([1.0] * terms.shape[1] + [1e-6])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-inputs @ weights))
            slope = inputs.T @ (p - labels) + ridge @ weights
            bend = (inputs * (p * (1 - p) + 1e-9)[:, None]).T @ inputs + ridge
            weights = weights - np.linalg.solve(bend, slope)
        self.weights = weights

    @staticmethod
    def terms(features: np.ndarray) -> np.ndarray:
        """The difference towards good and towards bad have their own slopes."""
        difference, ratio = features[:, 0], features[:, 1]
        return np.column_stack([np.maximum(difference, 0), np.minimum(difference, 0), ratio])

    def __call__(self, difference: Column, ratio: Column) -> Column:
        """The probability of label 1 as a column."""
        total = F.lit(float(self.weights[-1]))
        zero = F.lit(0.0)
        for term, mean, scale, weight in zip((F.greatest(difference, zero), F.least(difference, zero), ratio), self.mean, self.scale, self.weights, strict=False):
            total = total + (term - float(mean)) / float(scale) * float(weight)
        return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[dict, dict]:
    """Texts by label for the dictionaries, and others for the curve; which rows is decided on the labels alone."""
    judged = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isin(0, 1) & (id_remainder(doc_id, FOLDS) != HELD_OUT))
    one = judged.groupBy(F.col(doc_id).alias("id")).agg(F.min(quality).alias("label")).withColumn("order", hash_number(F.col("id").cast("string"), 15))
    first = [one.where(F.col("label") == label).orderBy("order", "id").limit(ROWS) for label in (1, 0)]
    chosen = first[0].unionByName(first[1])
    taught = docs.select(F.col(doc_id).alias("id"), F.coalesce(whole_or_pieces(text, TEXT_CHARS), F.lit("")).alias("text"))
    rows = taught.join(F.broadcast(chosen), "id").groupBy("id", "label", "order").agg(F.min("text").alias("text")).collect()
    training: dict[int, list[bytes]] = {0: [], 1: []}
    fitting: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(rows, key=lambda r: (r["order"], r["id"])):
        data = row["text"].encode("utf-8", "surrogatepass")
        (fitting if row["order"] % CURVE_SHARE == 0 else training)[row["label"]].append(data)
    return training, fitting


def fitted(training: dict, fitting: dict) -> tuple[Compressors, Curve] | float:
    """The classifier, or the labels' mean where there is only one label, or none, to learn from."""
    fitting = {label: fitting[label] or training[label] for label in (0, 1)}
    if not all(training.values()) or not all(fitting.values()):
        counts = [len(training[label]) + len(fitting[label]) for label in (0, 1)]
        return counts[1] / sum(counts) if sum(counts) else 0.5
    made = Compressors(training[1], training[0])
    features = np.array([made.features(text) for label in (0, 1) for text in fitting[label]])
    return made, Curve(features, np.repeat([0.0, 1.0], [len(fitting[0]), len(fitting[1])]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", score: str = "quality_score", kept: str = "quality_kept"
) -> DataFrame:
    """``docs`` with ``score`` and ``kept`` (0 or 1), learned from ``labels``."""
    model = fitted(*labelled_sample(docs, labels, doc_id, text, quality))
    if isinstance(model, float):
        return docs.withColumns({score: F.lit(model), kept: F.lit(int(model >= THRESHOLD))})
    shared, curve = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf(SCORES)
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [shared.value.features((text or "").encode("utf-8", "surrogatepass")) for text in batch]
            yield pd.DataFrame(rows, columns=SCORES.names, dtype="float64")

    found = docs.withColumn(score, features(F.col(text)))
    scored = found.withColumn(score, curve(F.col(f"`{score}`.difference"), F.col(f"`{score}`.ratio")))
    return scored.withColumn(kept, (F.col(score) >= THRESHOLD).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))
