"""The pipeline's stages: ``(spark, docs, folder of the tables) -> DataFrame``.

All but the last keep the columns of ``docs`` and drop rows; the last one gives token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtally.llm import circulant_minhash, cotraining, line_rules, segment_bpe, spaced_seeds
from voxtally.llm.common import read_table
from voxtally.llm.queries import MULTI_RANKS, PATTERN


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled documents as they came in, before any stage dropped bad ones."""
    model = cotraining.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return cotraining.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return circulant_minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.without_overlaps(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segment_bpe.encode_documents(docs, MULTI_RANKS, PATTERN)
