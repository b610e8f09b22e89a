"""Corpus pipeline over `documents`: quality, near-dedup, substring dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Empty tables pass through; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import bpe, decontaminate, quality, simhash, substrings
from codeweave.llm.common import Tables


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels keeps."""
    return quality.keep_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: a similarity of 0.8 or more by shingles of five words."""
    return simhash.keep_first(docs, words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that stand elsewhere; n_chars follows."""
    out = substrings.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, with the digest of the bytes they decode to."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], decode=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminated),
    ("tokenize", tokenize),
]

#: Hashes, models and components are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = tables.put(stage(spark, docs, sf_dir), name)
        if i:
            tables.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
