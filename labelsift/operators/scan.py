"""M12 dataset scan and its helpers.

``scan`` screens any table with a text column: non-blank rows keep their
original row key, the scan TF-IDF configuration feeds an isolation forest
with unsupervised contamination ``min(.05, max(1/n, .001))``, and the result
is a set of lazy DataFrames -- scored rows, flagged rows ranked by score,
a display view, a score histogram and ground-truth metrics when the table
carries verified ground truth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.functions.columns import nonblank, safe_div, truncate_display
from labelsift.operators import metrics as M
from labelsift.operators import tfidf as TF
from labelsift.session import materialize, spread, stored

# Preferred text-column names, in priority order.
PREFERRED_TEXT_COLUMNS = ("text", "content", "review", "message", "sms", "sentence",
                          "body", "comment", "description", "document")
SOURCE_ROW = "source_row"
MIN_RECORDS = 5


def find_text_column(schema: T.StructType) -> str | None:
    """P3, metadata only: the column with the least (rank of its trimmed
    lower-cased name in ``PREFERRED_TEXT_COLUMNS``, position; the last of equal
    names first), else the first string column, else None."""
    ranked = [(PREFERRED_TEXT_COLUMNS.index(f.name.strip().lower()), -i, f.name)
              for i, f in enumerate(schema.fields) if f.name.strip().lower() in PREFERRED_TEXT_COLUMNS]
    if ranked:
        return min(ranked)[2]
    return next((f.name for f in schema.fields if isinstance(f.dataType, T.StringType)), None)


def require_records(df: DataFrame, n: int, min_rows: int = MIN_RECORDS) -> None:
    """P7 on a table with ``n`` usable records; reads a row only to word the
    error."""
    if n < min_rows:
        if df.isEmpty():
            raise ValueError("cannot screen an empty table")
        raise ValueError(f"screening needs {min_rows} or more records with text, got {n}")


def nonblank_rows(df: DataFrame, text_col: str, min_rows: int = MIN_RECORDS) -> DataFrame:
    """P6 + P7: rows whose text is not blank after stripping (the raw text is
    kept); raises when the table is empty or has fewer than ``min_rows``
    usable records. The guard reads at most ``min_rows`` rows."""
    kept = df.where(nonblank(text_col))
    require_records(df, kept.limit(min_rows).count(), min_rows)
    return kept


def flagged_view(flagged: DataFrame, key: str, text_col: str, n: int = 100, width: int = 180) -> DataFrame:
    """P13 + L3 + L4: top ``n`` flagged rows by score (ties by key), text cut
    to ``width`` chars, score at 4 dp, plus ``label`` / ``is_poisoned`` when
    present."""
    extra = [c for c in ("label", "is_poisoned") if c in flagged.columns]
    top = flagged.orderBy(F.desc("anomaly_score"), F.asc(key)).limit(n)
    return top.select(F.col(key).alias(SOURCE_ROW) if key != SOURCE_ROW else F.col(key),
                      truncate_display(text_col, width).alias(text_col),
                      F.round("anomaly_score", 4).alias("anomaly_score"), *extra)


@dataclass
class ScanResult:
    text_column: str
    key: str
    n_scanned: int
    contamination: float
    scored: DataFrame       # input columns + anomaly_score + potentially_suspicious
    flagged: DataFrame      # P10, ranked (L3)
    display: DataFrame      # P13 / L4
    histogram: DataFrame    # A13
    metrics: DataFrame      # A7, A8, A10, A12 (one row)
    truth_source: str | None


def _require_unique(counted: DataFrame, key: str) -> None:
    bad = counted.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"column {key!r} is not a row key: {bad[0][0]!r} occurs {bad[0][1]} times")


def scan(df: DataFrame, key: str | None = None, text_col: str | None = None,
         trees: int = 200, psi: int = 256, seed: int = 42,
         cfg: TF.TfidfConfig = TF.SCAN) -> ScanResult:
    """M12. The whole input row rides along the tokeniser, the vectors and the
    forest scores (each a map over the rows), so no exchange or sort carries
    text; rows are written with their term counts and with their scores."""
    from labelsift.plans.detect import run_forest
    from labelsift.sources.corpus import with_file_order_key

    text_col = text_col or find_text_column(df.schema)
    if text_col is None:
        raise ValueError("the table has no string column to screen")
    given = key
    if key is None:
        key = SOURCE_ROW
        df = with_file_order_key(df, key)  # P8: raises when the name is taken
    names = [c for c in df.columns if c not in ("anomaly_score", "potentially_suspicious")]
    rows = df.where(nonblank(text_col)).select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{text_col}`").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    counted = stored(TF.counts(spread(rows), "_key", "_text", cfg, ["_row"]), "counts")
    n = counted.count()
    require_records(df, n)
    if given is not None:
        _require_unique(counted, "_key")
    contamination = M.contamination_for(n)
    vocab = TF.fit_counts(TF.explode_counts(counted, "_key"), cfg, n)
    vocab.table = materialize(vocab.table)
    vocab.size = vocab.table.count()
    vecs = TF.vectorize(counted, "_key", vocab, carry=["_row"])

    def vectors_of(chosen: DataFrame) -> DataFrame:
        return TF.vectorize(counted.join(F.broadcast(chosen), "_key", "left_semi"), "_key", vocab)

    scores = run_forest(vecs, "_key", vocab.size, n, contamination, trees, psi, seed, carry=("_row",),
                        keys=counted.select("_key"), vectors_of=vectors_of)
    scored = scores.select("_row.*", "anomaly_score",
                           (F.col("detector_flag") == 1).alias("potentially_suspicious"))
    flagged = scored.where("potentially_suspicious").orderBy(F.desc("anomaly_score"), F.asc(key))
    with_truth, source = M.ground_truth(scored, "_truth")
    pred = F.col("potentially_suspicious").cast("int")
    if source is not None:
        metrics = M.gated_scores(with_truth.withColumn("_pred", pred), "_truth", "_pred")
    else:
        metrics = scored.agg(F.count(F.lit(1)).alias("total"),
                             F.count_if("potentially_suspicious").alias("flagged")) \
            .withColumn("flag_rate", safe_div("flagged", "total")) \
            .withColumn("both_classes", F.lit(False)) \
            .select("total", "flagged", "flag_rate", "both_classes",
                    *[F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "f1")])
    return ScanResult(text_col, key, n, contamination, scored, flagged,
                      flagged_view(flagged, key, text_col), M.histogram(scores, "anomaly_score", 30),
                      metrics.withColumn("text_column", F.lit(text_col))
                             .withColumn("truth_source", F.lit(source)), source)
