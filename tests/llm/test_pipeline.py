import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing, pii, quality, simhash
from tests.llm.conftest import CLASHES
from tests.llm.test_simhash import brute_components, brute_fingerprint

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage by itself on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_filter", "near_dedup", "pseudonyms", "mixture", "tokens"]
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = spark.createDataFrame((made := stage(spark, docs, sf_dir)).collect(), made.schema)
        if name != "tokens":
            assert docs.columns == DOCUMENTS
    result = docs

    ids = lambda df: sorted(row["doc_id"] for row in df.select("doc_id").collect())
    scored = quality.quality_scores(inputs["quality_filter"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(inputs["near_dedup"]) == ids(scored.where("quality_score >= 0.3"))

    prints = {row["doc_id"]: brute_fingerprint(row["text"]) for row in inputs["near_dedup"].collect()}
    assert ids(inputs["pseudonyms"]) == sorted(set(brute_components(prints).values()))

    permute = pii.Permuter(pii.session_key(spark))
    before = {row["doc_id"]: row for row in inputs["pseudonyms"].collect()}
    after = {row["doc_id"]: row for row in inputs["mixture"].collect()}
    assert set(before) == set(after)
    for i, row in after.items():
        assert row["text"] == pii.replace(before[i]["text"], permute)[0]
        assert row["n_chars"] - before[i]["n_chars"] == len(row["text"]) - len(before[i]["text"])

    assert ids(inputs["tokens"]) == ids(mixing.sample(inputs["mixture"]))

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for row in result.collect():
        assert row["ids"] == [*library.encode(after[row["doc_id"]]["text"]), library.eos_id()] and row["n_tokens"] == len(row["ids"])
    assert ids(result) == ids(inputs["tokens"])
    assert not any(re.search(r"and\.34@mail7", row["text"] or "") for row in after.values())

    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, result.collect()))


def test_stages_on_odd_documents(spark, sf_dir, odd_documents, no_documents):
    for docs in (odd_documents, odd_documents.select(DOCUMENTS), no_documents):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf_dir)
            rows = made.collect()
            assert len(rows) <= docs.count()
            if name != "tokens":
                assert made.columns == docs.columns
            if name != "tokens" and "made" in docs.columns:  # columns that are named like an operator's keep their values
                assert all(row[column] == "clash" for row in rows for column in CLASHES)


def test_no_key_stands_in_the_source(spark, sf_dir):
    """The session's secret decides; without one each session makes its own."""
    docs = spark.createDataFrame([(1, "mail ann@example.com", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    made = []
    for secret in ("one", "two", "one"):
        spark.conf.set(pii.SECRET, secret)
        made.append(corpus_pipeline.pseudonyms(spark, docs, sf_dir).first()["text"])
    spark.conf.unset(pii.SECRET)
    own = pii.session_key(spark)
    assert made[0] == made[2] != made[1] and len(own) == 64 and pii.session_key(spark) == own and spark.newSession().conf.get(pii.SECRET, None) is None


def test_copies_go_and_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    both = docs.unionByName(copies)
    assert simhash.one_of_each(both).where("doc_id >= 1000000").isEmpty()
    assert simhash.one_of_each(both).count() == simhash.one_of_each(docs).count()
