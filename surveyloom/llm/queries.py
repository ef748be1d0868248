"""Queries of the operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op6_chat as op6
from .op1_decontamination import overlaps
from .op2_jaccard_join import jaccard_components
from .op3_secrets import scan, vocabulary
from .op4_sharding import shard_corpus
from .op5_substring_dedup import digest, parse
from .op7_quality_rules import quality_rules
from .op8_packing import first_line_bytes, pack
from .op9_licenses import scan_licenses
from .op10_quality_classifier import classify
from .op11_bpe import round_trip
from .op12_repair import damage, repair_conversations
from .op13_whitening import whiten
from .oracles import ORACLES
from .shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90).drop("class_size")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return scan(_table(spark, sf_dir, "documents"), dictionary=vocabulary(files.path("word_bpe_49k.json")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals, dealt by the hash of the id, then compaction to files of 128 MB; digests of the texts that the shards hold."""
    docs = _table(spark, sf_dir, "documents")
    arrivals = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k) for k in range(3)]
    rows = shard_corpus(arrivals, fresh_path(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.length("text").alias("text_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(parse(_table(spark, sf_dir, "documents")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.collapse(_table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first line before other text is a prompt; where a sequence holds prompts, at most 1,984 of its tokens bear loss."""
    import public_tokenizers as files

    paths = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN
    return pack(_table(spark, sf_dir, "documents"), *paths, segments=256, loss=1984, plain_loss=2048, prompt_bytes=first_line_bytes(F.col("text")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return round_trip(_table(spark, sf_dir, "documents"), files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_conversations(damage(conversations), conversations)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat": op6_chat,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_bpe": op11_bpe,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {"op6_chat": op6.ORACLE} | ORACLES
