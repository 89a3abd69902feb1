"""Scoring against ground truth: A7-A13, P12, P14, M3-M5, R12.

Every metric is computed from the four confusion counts of one aggregation
pass (``count_if``), never from a library evaluator; zero division gives 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.columns import safe_div, strip_ws
from labelsift.operators.quantile import exact_percentile

# Strings that count as "poisoned" in an is_poisoned column.
TRUTHY = ("1", "true", "yes", "y", "poisoned", "poison")


def _cells(truth: str, pred: str) -> list[Column]:
    """A9 aggregates over the fixed labels {0, 1}."""
    t, p = F.col(truth), F.col(pred)
    return [F.count_if((t == a) & (p == b)).alias(name)
            for name, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def confusion(df: DataFrame, truth: str = "is_poisoned", pred: str = "detector_flag",
              by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts over the fixed labels {0, 1}; an absent class still
    yields 0. Columns ``tn, fp, fn, tp`` (BIGINT)."""
    return df.groupBy(*by).agg(*_cells(truth, pred))


def with_prf(conf: DataFrame) -> DataFrame:
    """A10: precision, recall and F1 of the positive class from A9 counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.select("*",
                       safe_div(tp, tp + fp).alias("precision"),
                       safe_div(tp, tp + fn).alias("recall"),
                       safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_flags(df: DataFrame, truth: str = "is_poisoned", pred: str = "detector_flag",
                by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with totals, rates, confusion and P/R/F1."""
    t, p = F.col(truth), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(t == 1).alias("actual_poisoned"),
            F.count_if(t == 0).alias("actual_clean"),
            F.count_if(p == 1).alias("flagged"), *_cells(truth, pred)]
    base = df.groupBy(*by).agg(*aggs)
    return with_prf(base).withColumn("flag_rate", safe_div("flagged", "total")) \
                         .withColumn("poison_rate", safe_div("actual_poisoned", "total"))


def gated_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """precision/recall/F1 only when both truth classes occur, else null."""
    s = score_flags(df, truth, pred).withColumn(
        "both_classes", (F.col("actual_poisoned") > 0) & (F.col("actual_clean") > 0))
    gate = F.col("both_classes")
    return s.select("total", "flagged", "flag_rate", "both_classes",
                    *[F.when(gate, F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def confusion_pivot(df: DataFrame, truth: str = "is_poisoned", pred: str = "detector_flag") -> DataFrame:
    """2x2 matrix ``[[tn, fp], [fn, tp]]`` as rows ``actual`` with columns
    ``pred_0, pred_1`` (fixed pivot values, so both columns always exist)."""
    return (df.where(F.col(truth).isin(0, 1) & F.col(pred).isin(0, 1))
              .groupBy(F.col(truth).cast("int").alias("actual"))
              .pivot(pred, [0, 1]).agg(F.count(F.lit(1)))
              .select("actual", F.coalesce(F.col("0"), F.lit(0)).cast("bigint").alias("pred_0"),
                      F.coalesce(F.col("1"), F.lit(0)).cast("bigint").alias("pred_1")))


def truth_from_flag(col: str = "is_poisoned") -> Column:
    """P12 first rule: the string form, stripped and lower-cased, is one of TRUTHY."""
    return F.when(F.lower(strip_ws(F.col(col).cast("string"))).isin(*TRUTHY), 1).otherwise(0)


def truth_from_labels(original: str = "original_label", label: str = "label") -> Column:
    """P12 second rule: stripped string forms differ (null equals null)."""
    a = strip_ws(F.col(original).cast("string"))
    b = strip_ws(F.col(label).cast("string"))
    return F.when(a.eqNullSafe(b), 0).otherwise(1)


def ground_truth(df: DataFrame, out: str = "truth") -> tuple[DataFrame, str | None]:
    """Attach verified ground truth when the table carries it.

    Returns ``(df, source)``; without usable columns the frame is unchanged
    and ``source`` is None (schema-only decision, no job).
    """
    # The two source names below are fixed values of the output contract.
    if "is_poisoned" in df.columns:
        return df.withColumn(out, truth_from_flag("is_poisoned")), "is_poisoned column"
    if "original_label" in df.columns and "label" in df.columns:
        return df.withColumn(out, truth_from_labels()), "original_label vs label"
    return df, None


def contamination_supervised(poison_rate: Column | float) -> Column:
    """M3: the true poison rate clamped to [0.001, 0.49]."""
    r = poison_rate if isinstance(poison_rate, Column) else F.lit(float(poison_rate))
    return F.greatest(F.least(r, F.lit(0.49)), F.lit(0.001))


def contamination_unsupervised(n: Column | int) -> Column:
    """M4: ``min(0.05, max(1/n, 0.001))``."""
    c = n if isinstance(n, Column) else F.lit(int(n))
    return F.least(F.lit(0.05), F.greatest(F.lit(1.0) / c, F.lit(0.001)))


def contamination_for(n: int) -> float:
    """M4 as a number."""
    return min(0.05, max(1.0 / n, 0.001))


def contamination_offset(df: DataFrame, score: str, contamination: float) -> float:
    """M5 offset: the interpolated ``100*contamination`` percentile of
    ``-score`` (exact, no global sort)."""
    neg = df.select((-F.col(score)).alias("_neg"))
    return exact_percentile(neg, "_neg", float(contamination))


def apply_offset(df: DataFrame, score: str, offset: float, flag: str = "flag",
                 shifted: str = "anomaly_score") -> DataFrame:
    """``shifted = score + offset``; flagged iff ``shifted > 0``."""
    return df.withColumn(shifted, F.col(score) + F.lit(float(offset))).withColumn(
        flag, F.when(F.col(shifted) > 0, 1).otherwise(0))


def flag_by_contamination(df: DataFrame, score: str, contamination: float,
                          flag: str = "flag", shifted: str = "anomaly_score") -> DataFrame:
    """M5 + P14: offset from the training scores themselves, then a row is
    flagged iff it lies strictly beyond the percentile."""
    return apply_offset(df, score, contamination_offset(df, score, contamination), flag, shifted)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram, ``bins`` buckets over [min, max].

    ``bin = least(floor((x - min) / (max - min) * bins), bins - 1)``; a zero
    range puts every row in bin 0. Empty bins are not emitted. Two passes: a
    one-row min/max, then a partial-aggregated count per bin.
    """
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    span = float(hi) - float(lo)
    if span == 0:
        b = F.lit(0)
        width = 0.0
    else:
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(span) * F.lit(bins)), F.lit(bins - 1)).cast("int")
        width = span / bins
    return (df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")
              .orderBy("bin"))
