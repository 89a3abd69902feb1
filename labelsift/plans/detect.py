"""E1 detect plan: poisoned corpus -> detect TF-IDF -> isolation forest ->
flags -> metrics (the reference's detection stage, as lazy Spark plans).

Written intermediates (in the shared checkpoint folder): the row-local term
counts (read by the vocabulary fit and by the vectors), the vectors (read by
the forest's sample and by scoring) and the ``(key, score)`` table (read by the exact-percentile passes
and the joins).
The poisoned corpus itself is never checkpointed: it is the source scan plus
the key join plus a row-local predicate with fitted constants, so re-deriving
it is cheaper than writing the texts again, and consumers that need no text
(counts, metrics) have the text column pruned at the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.operators import iforest as IF
from labelsift.operators import metrics as M
from labelsift.operators import poison as X
from labelsift.operators import tfidf as T
from labelsift.plans.common import RATE, SEED, corpus
from labelsift.session import stored


@dataclass
class Detection:
    scores: DataFrame       # key, score, anomaly_score, detector_flag
    contamination: float
    n: int
    n_features: int


def featurize(df: DataFrame, key: str, text: str, cfg: T.TfidfConfig,
              n: int | None = None) -> tuple[DataFrame, int, T.Vocabulary]:
    """Fit + transform: sparse vectors ``(key, indices, values)`` of every row
    (rows without vocabulary terms get empty arrays), a map over the stored
    counts."""
    vocab, _, vecs = T.fit_vectors(df, key, text, cfg, n)
    return vecs, int(vocab.size), vocab


def run_forest(vecs: DataFrame, key: str, n_features: int, n: int, contamination: float,
               trees: int = 200, psi: int = 256, seed: int = SEED, carry: tuple = (),
               keys: DataFrame | None = None,
               vectors_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """M1 + M2 + M5: ``(key, *carry, score, anomaly_score, detector_flag)``.
    Scores are written once; the percentile passes read their column alone.
    ``keys`` and ``vectors_of`` as in ``fit_nodes``."""
    nodes, psi_eff, depth = IF.fit_nodes(vecs, key, n_features, n, trees, psi, seed, keys, vectors_of)
    forest = IF.collect_forest(nodes, psi_eff, depth)
    scored = stored(IF.score(vecs, key, forest, n_features, "score", carry), "scores")
    return M.flag_by_contamination(scored, "score", contamination, "detector_flag", "anomaly_score")


def detect(poisoned: DataFrame, key: str = "row_id", text: str = "text",
           cfg: T.TfidfConfig = T.DETECT, trees: int = 200, psi: int = 256,
           seed: int = SEED) -> Detection:
    """Score every row; contamination is the true poison rate clamped to
    [0.001, 0.49] (M3, as in the reference -- a stated label leak)."""
    counts = poisoned.agg(F.count(F.lit(1)).alias("n"),
                          F.count_if(F.col("is_poisoned") == 1).alias("p")).first()
    n, p = int(counts["n"]), int(counts["p"])
    rate = p / n if n else 0.0
    contamination = max(min(rate, 0.49), 0.001)
    vecs, n_features, _ = featurize(poisoned, key, text, cfg, n)
    # written: else the draw, the sample and the scores would each compute them, and
    # the weighing and the scoring would be two Python workers of one task
    vecs = stored(vecs, "vectors")
    scores = run_forest(vecs, key, n_features, n, contamination, trees, psi, seed)
    return Detection(scores, contamination, n, n_features)


def detection_output(poisoned: DataFrame, det: Detection, key: str = "row_id") -> DataFrame:
    """The reference's detection table: input rows + ``detector_flag`` +
    ``anomaly_score``. J2: the reference aligns score arrays by position;
    here the scores carry the row key, so this is one key join (both sides
    grow with the data, so the planner picks the strategy). When the corpus
    is a sort-merge join on the key, its partitioning is reused and only the
    narrow ``(key, score)`` side is shuffled (checked with ``explain``)."""
    return poisoned.join(det.scores.select(key, "detector_flag", "anomaly_score"), key)


def detection_record(poisoned: DataFrame, det: Detection, key: str = "row_id",
                     seed: int = SEED) -> DataFrame:
    """M11 detection section as one flat row (metrics from A9 counts)."""
    j = poisoned.select(key, "is_poisoned").join(det.scores.select(key, "detector_flag"), key)
    s = M.score_flags(j, "is_poisoned", "detector_flag")
    return s.select(
        F.lit("Isolation Forest").alias("detector"), F.lit("TF-IDF").alias("feature_extraction"),
        F.lit(seed).alias("random_state"), F.col("total").alias("total_samples"),
        "actual_poisoned", "actual_clean", F.col("flagged").alias("flagged_samples"),
        "flag_rate", "precision", "recall", "f1",
        F.col("tp").alias("true_positive"), F.col("fp").alias("false_positive"),
        F.col("fn").alias("false_negative"), F.col("tn").alias("true_negative"))


def poisoned_corpus(spark: SparkSession, sf: str, seed: int = SEED, rate: float = RATE) -> DataFrame:
    return X.flip_labels(corpus(spark, sf), "row_id", "label", rate, seed)


def detection_metrics(spark: SparkSession, sf: str, trees: int = 200) -> DataFrame:
    """Flagship: corpus -> 5 % flip -> detect features -> forest -> metrics."""
    p = poisoned_corpus(spark, sf)
    det = detect(p, trees=trees)
    return detection_record(p, det)
