"""Corpus profile: A1-A6 aggregates and L1/L2 samples.

Each function is one aggregation job (map-side partial aggregation, a single
small final stage), so a hot label or text value costs one row per partition,
never one overloaded task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview(df: DataFrame) -> DataFrame:
    """A1: row count and column list (column metadata needs no job)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"))


def label_distribution(df: DataFrame, label: str = "label", by: str = "count") -> DataFrame:
    """A2 (``by='count'``, count desc) / A3 (``by='label'``): label histogram,
    nulls not counted; L5 is the ordering of the two forms."""
    h = (df.where(F.col(label).isNotNull()).groupBy(label)
           .agg(F.count(F.lit(1)).alias("n")))
    return h.orderBy(F.desc("n"), label) if by == "count" else h.orderBy(label)


def missing_values(df: DataFrame) -> DataFrame:
    """A4: null count per column as ``(column_name, n_missing)`` rows -- one
    pass computes every column, then ``stack`` turns the row into rows."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    return wide.unpivot([], df.columns, "column_name", "n_missing").select(
        "column_name", F.col("n_missing").cast("bigint").alias("n_missing"))


def duplicate_count(df: DataFrame, col: str = "text") -> DataFrame:
    """A5: rows that repeat an earlier value (null equals null).

    Distinct texts are counted on a 128-bit digest of the text, so the
    distinct-aggregation shuffle carries 16 bytes per distinct value per
    partition instead of whole texts.
    """
    c = F.col(col)
    digest = F.unhex(F.md5(c.cast("string")))
    return df.agg(
        (F.count(F.lit(1)) - F.count_distinct(digest)
         - F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))).cast("bigint").alias("n_duplicates"))


def length_stats(df: DataFrame, col: str = "text") -> DataFrame:
    """Mean (2 dp), min and max length in characters (code points)."""
    n = F.char_length(F.col(col))
    return df.agg(F.round(F.avg(n), 2).alias("avg_chars"),
                  F.min(n).cast("bigint").alias("min_chars"),
                  F.max(n).cast("bigint").alias("max_chars"))


def head_rows(df: DataFrame, key: str = "row_id", n: int = 5) -> DataFrame:
    """L1: first ``n`` rows by key (TakeOrderedAndProject: per-partition top-n)."""
    return df.orderBy(key).limit(n)


def sample_texts(df: DataFrame, key: str = "row_id", text: str = "text",
                 label: str = "label", n: int = 3, width: int = 300) -> DataFrame:
    """L2: first ``n`` rows by key with the text cut to ``width`` characters."""
    return (df.orderBy(key).limit(n)
              .select(key, F.substring(text, 1, width).alias("text_head"), label))


def profile(df: DataFrame, key: str = "row_id", text: str = "text",
            label: str = "label") -> dict[str, DataFrame]:
    """All profile tables as lazy DataFrames."""
    return {
        "overview": overview(df),
        "label_distribution": label_distribution(df, label),
        "missing_values": missing_values(df),
        "duplicates": duplicate_count(df, text),
        "length_stats": length_stats(df, text),
        "head": head_rows(df, key),
        "samples": sample_texts(df, key, text, label),
    }
