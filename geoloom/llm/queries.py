"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .alignment import align_tokens
from .decontaminate import contamination
from .language import identify_language
from .lexical import rank_documents
from .near_dedup import near_duplicates
from .nearest import nearest_neighbours
from .packing import pack_documents
from .passages import repeated_passages
from .prefix_counts import token_totals
from .preferences import adjacent_pairs, format_preferences
from .quality import score_quality
from .sharding import shard_documents
from .staging import table
from .token_files import token_digests


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("text_crc32")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), end_id=1)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), window=4096, end_id=2).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair the counts and digests of prompt and completions, and the loss characters."""
    turns = table(spark, sf_dir, "conversations")
    pairs = format_preferences(turns, adjacent_pairs(turns))
    loss = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long")
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"),
        *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        loss("chosen_loss").alias("chosen_loss_chars"), loss("rejected_loss").alias("rejected_loss_chars"),
    )


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_passages(table(spark, sf_dir, "documents"), words=50, percent=80)
    return spans.select("doc_id", "match_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_crc32")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_totals(table(spark, sf_dir, "documents"), limit=512)


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_minhash_near_dedup,
        op3_multi_index,
        op4_token_files,
        op5_packing,
        op6_sharding,
        op7_preferences,
        op8_compact_windows,
        op9_decontamination,
        op10_language_id,
        op11_prefix_counts,
        op12_reversed_search,
        op13_token_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op7_preferences": oracles.PREFERENCES,
    "op9_decontamination": oracles.CONTAMINATION,
    "op12_reversed_search": oracles.LEXICAL,
}
