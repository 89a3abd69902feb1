"""Model experiments: M6-M8 train-and-evaluate, A11 accuracy / binary F1.

M6 is Spark ML's ``LogisticRegression`` set to the reference's objective
(L2, C = 1, intercept unpenalised): ``regParam = 1 / n_train``,
``elasticNetParam = 0``, ``standardization = False``, ``maxIter = 1000``,
``tol = 1e-7``. Spark's ``tol`` bounds the relative change of the objective,
not the gradient; 1e-7 is tight enough that every entry of the objective's
gradient, the intercept's included, is below 1e-4 (tests/test_experiment.py
checks the shipped setting).
Accuracy and F1 come from confusion counts (A9), never from the evaluator's
default weighted F1.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.functions.vectors import with_vectors
from labelsift.functions.columns import safe_div
from labelsift.operators import metrics as M
from labelsift.session import run_concurrently, ship_package


def model_frame(vecs: DataFrame, labels: DataFrame, key: str, size: int,
                label: str | dict[str, str] = "label") -> DataFrame:
    """Join sparse rows to one or more label columns and build ``features``.

    ``label`` may map output names to label columns, so models trained on
    the same vectors with different labels (clean vs flipped) share one frame.
    """
    ship_package(vecs.sparkSession)  # the vectors are built in Python workers
    names = {"label": label} if isinstance(label, str) else label
    lab = labels.select(key, *[F.col(src).cast("double").alias(dst) for dst, src in names.items()])
    return with_vectors(vecs.join(lab, key).select(key, *names.keys(), "indices", "values"), size)


ROWS_PER_TASK = 512  # below this a task's gradient costs less than its launch


def training_frame(frame: DataFrame, n: int | None = None) -> DataFrame:
    """Size a training frame for the many passes of L-BFGS: at most one
    partition per core of the cluster (an iteration costs a job whose tasks
    each emit a dense gradient) and, for ``n`` rows, none of a few rows only;
    cached once."""
    sc = frame.sparkSession.sparkContext
    parts = frame.rdd.getNumPartitions()
    target = max(1, min(parts, sc.defaultParallelism, -(-n // ROWS_PER_TASK) if n else parts))
    if target < parts:
        frame = frame.coalesce(target)
    return frame.persist(StorageLevel.MEMORY_AND_DISK)


LR_TOL = 1e-7


def fit_logreg(train: DataFrame, n_train: int, max_iter: int = 1000, tol: float = LR_TOL,
               label_col: str = "label", weight_col: str | None = None, total_weight: float | None = None):
    """M6. With ``weight_col`` the objective sums weighted losses
    (``total_weight`` is the weights' sum, which then takes the place of n). The gradient tree-aggregation depth (Spark's minimum is 2) grows
    with the partition count so the driver merges few dense gradients per
    iteration even on thousands of partitions."""
    parts = train.rdd.getNumPartitions()
    depth = 2 if parts <= 1024 else 3
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter,
                            regParam=1.0 / (total_weight or max(n_train, 1)), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=tol,
                            aggregationDepth=depth)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(train)


def fit_concurrently(fits: list[tuple]) -> list:
    """Independent model fits as concurrent Spark jobs: an L-BFGS iteration
    is a short job whose tasks cover only the training frame's partitions,
    so fits sharing a cluster overlap their per-iteration latency instead of
    queueing behind each other. ``fits`` holds ``(callable, *args)``."""
    return run_concurrently(fits)


def evaluate(model, test: DataFrame, key: str = "row_id") -> DataFrame:
    """M7 + A11: one row ``(n_test, accuracy, f1, tp, fp, fn, tn)``."""
    pred = model.transform(test).select(
        key, F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    s = M.score_flags(pred, "y", "p")
    return s.select(F.col("total").alias("n_test"),
                    safe_div(F.col("tp") + F.col("tn"), F.col("total")).alias("accuracy"),
                    "f1", "tp", "fp", "fn", "tn")
