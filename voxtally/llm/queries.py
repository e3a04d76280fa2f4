"""Registered queries of the operators: ``(spark, folder of the tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm import (
    bitplane_clusters,
    circulant_minhash,
    cotraining,
    golay_simhash,
    kronecker_negatives,
    licenses,
    line_rules,
    segment_bpe,
    spaced_seeds,
    token_counts,
    token_files,
    warc,
    word_backoff,
)
from voxtally.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


JSON_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_spaced_seeds(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return spaced_seeds.overlaps(documents, read_table(spark, sf_dir, "benchmark"))


@query
def op2_word_backoff(spark, sf_dir):
    return word_backoff.identify(read_table(spark, sf_dir, "documents"))


@query
def op3_cotraining(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    seen = cotraining.figures(documents)
    return cotraining.classify(documents, cotraining.fit(documents, read_table(spark, sf_dir, "labels"), seen), seen)


@query
def op4_token_files(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return token_files.token_file_round_trip(spark, documents, JSON_TOKENIZER, PATTERN)


@query
def op5_line_rules(spark, sf_dir):
    return line_rules.apply_rules(read_table(spark, sf_dir, "documents"))


@query
def op6_licenses(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return licenses.scan(documents, licenses.fit(spark, documents))


@query
def op7_segment_bpe(spark, sf_dir):
    return segment_bpe.encode_documents(read_table(spark, sf_dir, "documents"), MULTI_RANKS, PATTERN)


@query
def op8_warc(spark, sf_dir):
    found = warc.archive_round_trip(spark, read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_circulant_minhash(spark, sf_dir):
    found = circulant_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), RANKS, PATTERN)


@query
def op11_golay_simhash(spark, sf_dir):
    return golay_simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op12_kronecker_negatives(spark, sf_dir):
    return kronecker_negatives.mine(read_table(spark, sf_dir, "embeddings"))


@query
def op13_bitplane_clusters(spark, sf_dir):
    return bitplane_clusters.cluster_vectors(read_table(spark, sf_dir, "embeddings"))
