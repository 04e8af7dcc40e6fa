import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import sentencepieces
from barloom.llm.queries import op3_piece_prefixes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
OWN, LIBRARY = sentencepieces.encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = [LIBRARY.id_to_piece(i) for i in range(259, 32_000, 37)]


@settings(max_examples=300)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from([*PIECES, " ", "  ", "\n", ".", ",", "1", "'s", "▁", "</s>", "\0"]), max_size=20).map("".join)))
def test_encodes_like_the_library(text):
    assert OWN.encode(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "  two  blanks ", "1,234.56", "don't. (stop)", "\t\n\n", "日本語😀", "word***"])
def test_encodes_odd_texts_like_the_library(text):
    assert OWN.encode(text) == LIBRARY.encode(text) == OWN.encode(text)


def test_fits_is_what_merging_says():
    for left in range(300, 20_000, 1511):
        for right in range(300, 20_000, 1013):
            if OWN.pieces[left] in OWN.whole and OWN.pieces[right] in OWN.whole:
                merged = OWN.parts(OWN.pieces[left] + OWN.pieces[right])
                assert OWN.fits(left, right) == (merged == [OWN.pieces[left], OWN.pieces[right]])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 3)
    own = sentencepieces.PrefixEncoder(MODEL)
    text = "the quick brown fox, jumps over the lazy dog. " * 3
    assert own.encode(text) == LIBRARY.encode(text) and len(own.remembered) <= 4


def test_query_against_the_library(spark, sf_dir):
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_piece_prefixes(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = [*LIBRARY.encode(texts[row["doc_id"]]), LIBRARY.eos_id()]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_odd_documents(odd_documents, no_documents):
    made = odd_documents.select("doc_id", "text", sentencepieces.encoded(MODEL)(F.col("text")).alias("ids"))
    for row in made.select("*", sentencepieces.decoded(MODEL)(F.col("ids")).alias("back")).collect():
        assert row["ids"] == [*LIBRARY.encode(row["text"] or ""), LIBRARY.eos_id()] and row["back"] == (row["text"] or "")
    assert sentencepieces.token_digests(odd_documents, MODEL).count() == odd_documents.count()
    assert sentencepieces.token_digests(no_documents, MODEL).collect() == []
