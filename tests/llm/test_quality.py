import math
import zlib

import pytest
import zstandard

from barloom.llm import quality
from barloom.llm.queries import op4_compression_quality
from tests.conftest import TESTDATA


def held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_query_tells_held_out_labels_apart(spark):
    sf_dir = str(TESTDATA / "sf0.01")
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {row["doc_id"]: row for row in op4_compression_quality(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(row["held_out"] == held(i) and 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3) for i, row in rows.items())
    judged = [(rows[i]["score"], label) for i, label in labels.items() if held(i) and i in rows]
    good, bad = [s for s, label in judged if label == 1], [s for s, label in judged if label == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - label if held(i) else label) for i, label in labels]
    scores = [
        {row["doc_id"]: row["quality_score"] for row in quality.quality_scores(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()}
        for rows in (labels, turned)
    ]
    assert scores[0] == scores[1]


def test_scores_against_sizes_compressed_anew(spark, sf_dir):
    """Each score from the dictionaries alone: blocks compressed by the plain library, and a curve fitted by plain gradient steps."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    training, fitting = quality.labelled_sample(docs, labels)
    made = quality.Compressors(training[1], training[0])
    one = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=False, write_content_size=False, write_dict_id=False) for data in made.dictionaries]

    def features(text: bytes) -> tuple[float, float]:
        good, bad = (sum(len(c.compress(text[k : k + 1024])) for k in range(0, len(text), 1024)) for c in one)
        return ((bad - good) / len(text), (bad + good) / 2 / len(text)) if text else (0.0, 0.0)

    rows = [(features(text), label) for label in (0, 1) for text in fitting[label]]
    terms = [[max(d, 0.0), min(d, 0.0), r] for (d, r), _ in rows]
    mean = [sum(column) / len(rows) for column in zip(*terms, strict=True)]
    spread = [max(1e-9, math.sqrt(sum((x - m) ** 2 for x in column) / len(rows))) for column, m in zip(zip(*terms, strict=True), mean, strict=True)]
    scaled = [[(x - m) / s for x, m, s in zip(row, mean, spread, strict=True)] + [1.0] for row in terms]
    weights = [0.0] * 4
    for _ in range(4000):
        slope = [1e-3 * w * (k < 3) for k, w in enumerate(weights)]
        for row, (_, label) in zip(scaled, rows, strict=True):
            off = 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, row, strict=True)))) - label
            slope = [s + off * x / len(rows) for s, x in zip(slope, row, strict=True)]
        weights = [w - 4 * s for w, s in zip(weights, slope, strict=True)]
    texts = {row["doc_id"]: (row["text"] or "").encode() for row in docs.collect()}
    for row in op4_compression_quality(spark, sf_dir).collect():
        d, r = features(texts[row["doc_id"]])
        total = sum(w * (x - m) / s for w, x, m, s in zip(weights, [max(d, 0.0), min(d, 0.0), r], mean, spread, strict=False)) + weights[3]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=2e-3)


LONG_ID = next(i for i in range(1000, 1100) if not held(i))


def test_learning_from_whole_texts_and_repeated_ids(spark):
    """The end of a text teaches as its beginning does; a document beyond the bound gives pieces from all over; one row an id."""
    ids = [i for i in range(40) if not held(i)]
    docs = spark.createDataFrame([(i, "a" * 9000 + f" end{i}") for i in ids] + [(ids[0], "zz")] * 50 + [(LONG_ID, "".join(f"<{k}>" for k in range(90_000)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(LONG_ID, 1)], "doc_id long, quality int")
    training, fitting = quality.labelled_sample(docs, labels)
    texts = [text.decode() for label in (0, 1) for text in training[label] + fitting[label]]
    assert len(texts) == len(ids) + 1 and all(any(f"end{i}" in text for text in texts) for i in ids)
    (long,) = [text for text in texts if text.startswith("<")]
    assert len(long) <= quality.TEXT_CHARS + 8 and "<89999>" in long and "<45" in long


@pytest.mark.parametrize(("rows", "score"), [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, None), (None, 0)], 0.5), ([(3, 0), (3, 1)], 0.0)])
def test_too_few_labels(spark, odd_documents, rows, score):
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    scored = quality.quality_scores(odd_documents, labels)
    assert {row["quality_score"] for row in scored.collect()} == {score} and scored.columns.count("quality_score") == 1


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(1, 10)], "doc_id long, quality int, label string")
    scored = quality.quality_scores(odd_documents, labels)
    rows = scored.collect()
    assert len(rows) == odd_documents.count() and all(0 <= row["quality_score"] <= 1 for row in rows)
    assert len({row["quality_score"] for row in rows if row["doc_id"] in (2, 3, 7)}) == 1
    assert set(odd_documents.columns) <= set(scored.columns) and {row["made"] for row in rows} == {"clash"}
    assert quality.quality_scores(no_documents, labels).collect() == []


def test_blocks_cover_the_whole_text():
    made = quality.Compressors([b"good words here " * 50] * 20, [b"### *** %%% " * 50] * 20)
    clean = b"good words here " * 2000
    assert made.features(clean)[0] > made.features(clean + b"### *** %%% " * 2000)[0]
    assert made.features(b"") == (0.0, 0.0)
