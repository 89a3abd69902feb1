"""Controlled corruption: X1 exact-size seeded sample, X2 label flip (P11),
X3 summary, J1 index lookups, P9 mitigation filter.

X1 draws exactly ``floor(n * rate)`` rows: the rows with the smallest
``hash60(seed, key)`` (ties by key). The cut-off is found with the exact
order-statistic search (no global sort, no row through the driver); the
selection itself is then a row-local predicate, so flipping labels needs no
join and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.columns import hash60, safe_div
from labelsift.operators.quantile import column_stats, kth_values
from labelsift.session import materialize


@dataclass(frozen=True)
class Draw:
    """A fitted exact-k draw: rows with (h, key) <= (h_cut, key_cut)."""
    seed: int
    n: int
    k: int
    h_cut: int | None
    key_cut: object

    def predicate(self, key: str) -> Column:
        if self.k == 0:
            return F.lit(False)
        h = hash60(self.seed, key)
        return (h < F.lit(self.h_cut)) | ((h == F.lit(self.h_cut)) & (F.col(key) <= F.lit(self.key_cut)))


def exact_k(n: int, rate: float) -> int:
    """``int(n * rate)`` as the reference computes it (a double product, floored)."""
    return int(math.floor(n * float(rate)))


def draw(df: DataFrame, key: str = "row_id", rate: float = 0.05, seed: int = 42) -> Draw:
    """Fit the exact-size draw. Reads only the key column once into a
    checkpoint of (key, hash), then a few small aggregation passes."""
    keys = materialize(df.select(F.col(key).alias("k"), hash60(seed, key).alias("h")))
    stats = column_stats(keys, "h")  # n, min, max in one pass (h is never null)
    n = int(stats[0])
    k = exact_k(n, rate)
    if k == 0:
        return Draw(seed, n, 0, None, None)
    h_cut, key_cut = kth_values(keys, "h", [k - 1], tiebreak="k", stats=stats)[k - 1]
    return Draw(seed, n, k, int(h_cut), key_cut)


def flip_labels(df: DataFrame, key: str = "row_id", label: str = "label",
                rate: float = 0.05, seed: int = 42, fitted: Draw | None = None) -> DataFrame:
    """``original_label`` keeps the input label, ``label`` becomes
    ``1 - label`` on the drawn rows, ``is_poisoned`` marks them."""
    d = fitted or draw(df, key, rate, seed)
    sel = d.predicate(key)
    cols = []
    for c in df.columns:
        if c == label:
            cols.append(F.when(sel, F.lit(1) - F.col(label)).otherwise(F.col(label)).alias(label))
        else:
            cols.append(F.col(c))
    return df.select(*cols, F.col(label).alias("original_label"),
                     F.when(sel, 1).otherwise(0).alias("is_poisoned"))


def poison_index(poisoned: DataFrame, key: str = "row_id") -> DataFrame:
    """K2: ground-truth index table (keys of the flipped rows)."""
    return poisoned.where(F.col("is_poisoned") == 1).select(key)


def poison_summary(poisoned: DataFrame, label: str = "label") -> DataFrame:
    """Totals and the final label histogram in one pass.

    Output: one row per label value with the corpus-wide totals repeated --
    ``(label, n_label, total, n_poisoned, n_clean, poison_rate)``.
    """
    from pyspark.sql import Window
    per = (poisoned.groupBy(label)
           .agg(F.count(F.lit(1)).alias("n_label"),
                F.count_if(F.col("is_poisoned") == 1).alias("p"),
                F.count_if(F.col("is_poisoned") == 0).alias("c")))
    # the window runs over the aggregated rows only (one per label value)
    every = Window.partitionBy()
    return (per.select(label, "n_label",
                       F.sum("n_label").over(every).alias("total"),
                       F.sum("p").over(every).alias("n_poisoned"),
                       F.sum("c").over(every).alias("n_clean"))
            .where(F.col(label).isNotNull())
            .withColumn("poison_rate", safe_div("n_poisoned", "total"))
            .orderBy(label))


def poisoned_rows(df: DataFrame, index: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows listed in the ground-truth index (left semi join). The index
    grows with the data (5 %), so the planner picks the join strategy."""
    return df.join(index.select(key), key, "left_semi")


def clean_rows(df: DataFrame, index: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows not in the index (left anti join)."""
    return df.join(index.select(key), key, "left_anti")


def mitigate(df: DataFrame, by: str = "is_poisoned") -> DataFrame:
    """Keep rows whose mark is 0. A null mark fails ``= 0`` and is dropped,
    as in the reference. ``by='detector_flag'`` removes the detector's flags
    instead of the known ground truth."""
    return df.where(F.col(by) == 0)


def mitigation_counts(before: DataFrame, by: str = "is_poisoned") -> DataFrame:
    """P9 counts: loaded, identified, removed and remaining in one pass."""
    return before.agg(
        F.count(F.lit(1)).alias("n_loaded"),
        F.coalesce(F.sum(F.col(by)), F.lit(0)).cast("bigint").alias("n_identified"),
        F.count_if(~(F.col(by) == 0) | F.col(by).isNull()).alias("n_removed"),
        F.count_if(F.col(by) == 0).alias("n_remaining"))


def mark_draw(df: DataFrame, key: str = "row_id", rate: float = 0.05, seed="flag:42",
              out: str = "detector_flag") -> DataFrame:
    """Mark an exact-size seeded draw as a 0/1 column (X1 without the flip).

    Used as the stand-in detector of the metric fixtures: the first
    ``floor(n*rate)`` rows by ``md5('flag:<seed>:<key>')``.
    """
    d = draw(df, key, rate, seed)
    return df.withColumn(out, F.when(d.predicate(key), 1).otherwise(0))
