"""Mid-ranks of every row, ties included, without a window over the table.

Values are counted (copies of a value combine before the shuffle), the distinct
values are sorted over all tasks and their counts summed: inside a task's range by
a window over that range, before it by the totals of the ranges (one row each).
Rows take the rank of their value by a join with the written table of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsift.session import stored


def value_ranks(df: DataFrame, col: str) -> DataFrame:
    """``(col, rank, copies)`` for each non-null value: ``rank`` is the mean of the
    1-based places that its copies take in ascending order."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("copies"))
    ranged = stored(counted.repartitionByRange(col).withColumn("part", F.spark_partition_id()), "values")
    parts = ranged.groupBy("part").agg(F.sum("copies").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")  # one row a task
    shift = parts.select("part", before.alias("before"))
    upto = F.sum("copies").over(Window.partitionBy("part").orderBy(col))
    return ranged.withColumn("upto", upto).join(F.broadcast(shift), "part").select(
        col, (F.col("before") + F.col("upto") - (F.col("copies") - 1) / 2).alias("rank"), "copies")


def mid_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``<col>_rank`` for each column: its mid-rank as a share, 0 for
    the least and 1 for the greatest of distinct values (0.5 for a single row);
    null for null."""
    n = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    for c in cols:
        table = stored(value_ranks(df.select(c), c), "ranks")
        share = (F.col("rank") - 1) / F.lit(n[c] - 1) if n[c] > 1 else F.lit(0.5)
        df = df.join(table.select(F.col(c).alias("_v"), share.alias(f"{c}_rank")), F.col(c) == F.col("_v"), "left").drop("_v")
    return df


def median(cols: list[Column]) -> Column:
    """The median of a row's values, nulls left out."""
    got = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(got)
    low, high = F.get(got, F.floor((n - 1) / 2).cast("int")), F.get(got, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def rank_vote(df: DataFrame, signals: list[str], share: float) -> DataFrame:
    """Mid-ranks of the signals, ``vote`` (their median) and ``marked`` (in the
    highest ``share`` by at least half of the signals)."""
    ranked = mid_ranks(df, signals)
    ranks = [F.col(f"{c}_rank") for c in signals]
    hits = reduce(lambda a, b: a + b, [F.when(r > 1 - share, 1).otherwise(0) for r in ranks])
    return ranked.withColumn("vote", median(ranks)).withColumn("marked", 2 * hits >= len(signals))
