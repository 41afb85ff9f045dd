"""A training corpus from raw documents: clean, good, unique, mixed to target shares, tokenized.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
result as Parquet in the shared checkpoint folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import bpe, jaccard, mixing, quality, toxicity
from offerlake.llm.common import ship, stage
from offerlake.llm.queries import QUALITY_THRESHOLD, RANKS_FILE, TOXIC_THRESHOLD, table


#: The pipeline's workers carry what four stages imported, so the last one works in shorter blocks.
TOKEN_BLOCK_BYTES = 2_000_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger rejects go."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), TOXIC_THRESHOLD)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    ship(spark)
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities of their cell."""
    ship(spark)
    return mixing.sample(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    ship(spark)
    ranks = bpe.Ranks.load(RANKS_FILE, public_tokenizers.PATTERN)
    decoded = bpe.decode(bpe.encode(docs, ranks, block_bytes=TOKEN_BLOCK_BYTES), ranks)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: The trained models and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
