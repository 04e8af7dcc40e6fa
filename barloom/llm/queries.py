"""The registered queries of this package: one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bytepairs, centroids, conversations, langid, media, mixing, pii, quality, sentencepieces, sharding, simhash, topk, warc
from barloom.llm.util import dealt_table, table


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.document_media(dealt_table(spark, sf_dir, "documents")))


def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(dealt_table(spark, sf_dir, "documents"))


def op3_piece_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.token_digests(dealt_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = dealt_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.quality_scores(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").alias("predicted"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    drawn = mixing.sample(mixing.narrowed(docs))
    named = {name: F.col(f"mix_{name}") for name in mixing.DIMENSIONS}
    return drawn.select(
        "doc_id", *[column.alias(name) for name, column in named.items()], F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability")
    )


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymised(dealt_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return made.select("doc_id", "text", F.size("pii_found").cast("long").alias("n_found"), pii.counted(F.col("pii_found")).alias("kinds"))


def op8_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(rows, rows.where("vec_id % 100 = 0"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(dealt_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.sort_means(table(spark, sf_dir, "embeddings"))[0]


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.token_digests(dealt_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digested(conversations.damaged(table(spark, sf_dir, "conversations")), kept="kept")


REGISTERED = (
    op1_transport_stream, op2_cross_parsing, op3_piece_prefixes, op4_compression_quality, op5_extendible_shards,
    op6_raked_mixture, op7_feistel_pseudonyms, op8_block_pruned_top_k, op9_warc_revisits, op10_simhash, op11_sort_means, op12_byte_pairs, op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_extendible_shards": sharding.oracle(),
        "op6_raked_mixture": mixing.oracle(),
        "op8_block_pruned_top_k": topk.oracle(),
        "op9_warc_revisits": warc.oracle(),
        "op11_sort_means": centroids.oracle(),
        "op13_conversation_repair": conversations.oracle(),
    }
