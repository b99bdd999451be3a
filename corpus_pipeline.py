"""From raw documents to packed training batches: quality rules, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, minhash, mixing, packing, quality
from tessera.llm.common import documents, mark, release, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its length in token ids, bucket, batch and place; copies that the mix repeats are packed as rows."""
    return packing.pack_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("mixing", mixed), ("packing", packed)]
#: The stages fit models, sketch and schedule: SQL can't express them; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(before)  # the stage's own tables and its predecessor's output
    return STAGES[-1][1](spark, docs, sf_dir)
