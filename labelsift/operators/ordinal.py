"""Dense 0-based positions in a sort order, computed in the JVM.

``orderBy`` range-partitions the rows (a distributed sort); the sorted frame
is checkpointed so its partitioning is fixed; one aggregation counts rows per
partition (one row per partition reaches the driver) and the position is the
partition's offset plus the row's index inside the partition (the low bits of
``monotonically_increasing_id``). No row passes through Python or the driver,
and no single task sees more than one partition of the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.session import materialize

_LOW_BITS = (1 << 33) - 1


def ordinal(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` plus ``out`` BIGINT = position of the row in ``order`` (0-based).
    The order must be total (unique sort keys) for the result to be
    deterministic."""
    if out in df.columns:
        raise ValueError(f"column {out!r} already exists")
    cols = df.columns
    fixed = materialize(df.orderBy(*order))
    sizes = sorted((r["_pid"], r["n"]) for r in
                   fixed.groupBy(F.spark_partition_id().alias("_pid"))
                        .agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for pid, n in sizes:
        offsets.append((pid, run))
        run += n
    off = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    low = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))
    # the offsets table has one row per partition: a bounded broadcast
    keyed = (fixed.withColumn("_pid", F.spark_partition_id()).withColumn("_i", low)
                  .join(F.broadcast(off), "_pid"))
    return keyed.select((F.col("_off") + F.col("_i")).alias(out), *cols)
