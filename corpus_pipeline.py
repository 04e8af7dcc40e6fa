"""A training corpus out of ``documents``, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mixing, pii, quality, sentencepieces, simhash
from barloom.llm.util import free_name, table
from barloom.sources.shared import removed, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "piece_bpe_32k.model"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, doesn't reject."""
    score, kept = free_name(docs, "quality_score"), free_name(docs, "quality_kept")
    return quality.quality_scores(docs, table(spark, sf_dir, "labels"), score=score, kept=kept).where(F.col(kept) == 1).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that operator 10 links: fingerprints of three-word shingles at most three bits apart."""
    return simhash.one_of_each(docs).select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data, under the session's secret; ``n_chars`` follows the text."""
    before = docs.withColumn("n_chars", F.col("n_chars") - F.length("text"))
    made = pii.pseudonymised(before, pii.session_key(spark), found=free_name(docs, "pii_found"))
    return made.withColumn("n_chars", F.col("n_chars") + F.length("text")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities."""
    prefix = "mix_"
    while any(name.lower().startswith(prefix) for name in docs.columns):
        prefix = f"_{prefix}"
    return mixing.sample(docs, prefix=prefix).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the training rows."""
    made = docs.select("doc_id", "lang", "source", sentencepieces.encoded(public_tokenizers.path(TOKENIZER))(F.col("text")).alias("ids"))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter), ("near_dedup", near_dedup), ("pseudonyms", pseudonyms), ("mixture", mixture), ("tokens", tokens),
]

#: SQL expresses neither the classifier nor fingerprints nor tokens; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again, and all but the last are deleted then."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            removed(spark, f"{folder}/{before}")
        before = name
    return docs
