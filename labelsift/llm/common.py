"""Helpers shared by the operators: reading tables, written intermediates."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """What every operator needs of a session: the shared checkpoint folder
    and this package on the Python workers' path. Idempotent."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: a lineage cut that survives the loss of executors, is column-pruned
    when read again and is small on disk."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(batches, column: str = "text", limit: int = 1 << 22):
    """Arrow batches cut into slices of at most ``limit`` bytes of ``column``
    (one row at least), so that a worker never holds Python objects of a whole
    batch of long texts."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > at and held + n > limit:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if b.num_rows > at:
            yield b.slice(at)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partition count (the cluster's choice)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id BIGINT, text STRING)`` with null text as empty; every other
    column is left behind, so clashing names cannot reach an operator."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """Non-null join key ``(key_id, key_hash)`` of a row by id and text hash."""
    return [F.coalesce(doc_id, F.lit(-1)).alias("key_id"),
            F.xxhash64(text_hash, doc_id.isNull()).alias("key_hash")]


def packed(docs: DataFrame) -> DataFrame:
    """``(row STRUCT of all columns, key_id, key_hash)``: a join on the key adds
    names beside ``row`` only, so none can clash; ``select("row.*")`` unpacks."""
    key = row_key(F.col("row.doc_id").cast("bigint"),
                  F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) \
        .select("row", *key)
