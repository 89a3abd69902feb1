"""Corpus pipeline over ``documents``: quality rules, SimHash near-dedup, secret
redaction, mixing to target weights, BPE encoding.

``run`` applies ``STAGES`` in order; every stage's result is written as Parquet
into the shared checkpoint folder and read again as the next stage's input, so
a lost executor repeats part of one stage at most. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelsift.llm import bpe, fertility, mixing, secretscan, simhash
from labelsift.llm.common import prepare, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the fertility bands reject."""
    prepare(spark)
    return fertility.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of every SimHash component."""
    prepare(spark)
    return simhash.keep_one_per_component(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    prepare(spark)
    return secretscan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by their fitted rates; only documents that are
    most likely of a reduced domain can go."""
    prepare(spark)
    return mixing.repeat_by_rate(docs, mixing.quality_domains(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode: ``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)``."""
    prepare(spark)
    return bpe.encode(docs, with_ids=True).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets),
          ("mixture", mixture), ("tokens", tokens)]

# Tokenisers, SimHash and a trained classifier have no SQL; tests compare the
# pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
