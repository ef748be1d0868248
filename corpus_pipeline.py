"""From raw documents to packed training sequences, in five stages.

Each stage gets what the one before has kept; all but the last return the columns of
``documents``. Stages hand over Parquet tables in the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm.op1_decontamination import decontaminate
from surveyloom.llm.op2_jaccard_join import deduplicate
from surveyloom.llm.op3_secrets import redact, vocabulary
from surveyloom.llm.op7_quality_rules import clean_documents
from surveyloom.llm.op8_packing import first_line_bytes, pack
from surveyloom.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules, and lines that too many documents of a host share."""
    return clean_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that five-word shingles tie at a similarity of 0.8."""
    return deduplicate(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays."""
    import public_tokenizers as files

    return redact(docs, dictionary=vocabulary(files.path("word_bpe_49k.json")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens; first lines are prompts, and beside them at most 1,984 tokens bear loss."""
    import public_tokenizers as files

    paths = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN
    return pack(docs, *paths, segments=256, loss=1984, plain_loss=2048, prompt_bytes=first_line_bytes(docs["text"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL has no tokenizer and no random forest; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
