"""E2 impact experiment and the three-condition recovery experiment
(M6-M11): TF-IDF + logistic regression trained on clean, poisoned and
mitigated labels, evaluated on a held-out split.

The corpus is split by a seeded key hash (S3); poisoning is the exact-size
flip (X1/X2). In the impact experiment the vectoriser is fitted on the clean
training split and reused for poisoned training rows (flips leave text
unchanged, so the vectors are shared) and the test split. In the recovery
experiment every condition fits its own vectoriser, as the reference does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.operators import logreg as LR
from labelsift.operators import poison as X
from labelsift.operators import tfidf as T
from labelsift.plans.common import RATE, SEED, corpus
from labelsift.session import materialize, spread, stored
from labelsift.sources.corpus import train_test_split

TEST_RATE = 0.5


def splits(df: DataFrame, key: str = "row_id", test_rate: float = TEST_RATE,
           seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    s = train_test_split(df, key, test_rate, seed)
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "test").drop("split"))


def _frame(counted: DataFrame, vocab: T.Vocabulary, key: str, labels: dict[str, str]) -> DataFrame:
    """Vectors of counted rows with label columns (``out name -> column``), all
    carried on the row: no join, no exchange."""
    carry = list(dict.fromkeys(labels.values()))
    v = T.vectorize(counted, key, vocab, carry=carry, as_vector=int(vocab.size))
    return v.select(key, *[F.col(src).cast("double").alias(dst) for dst, src in labels.items()], "features")


def _vocabulary(counted: DataFrame, key: str, cfg: T.TfidfConfig, n: int) -> T.Vocabulary:
    vocab = T.fit_counts(T.explode_counts(counted, key), cfg, n)
    vocab.table = materialize(vocab.table)
    vocab.size = vocab.table.count()
    return vocab


def train_and_evaluate(train: DataFrame, test: DataFrame, cfg: T.TfidfConfig = T.MITIGATION,
                       key: str = "row_id", text: str = "text", label: str = "label",
                       max_iter: int = 1000) -> DataFrame:
    """M8: fit a vectoriser + model on ``train``, score ``test``; one row
    ``(n_train, n_test, accuracy, f1, ...)``."""
    counted = stored(T.counts(train, key, text, cfg, [label]), "counts")
    tested = stored(T.counts(test, key, text, cfg, [label]), "counts")
    return _fit_and_score(counted, tested, cfg, key, label, max_iter)


def _fit_and_score(counted: DataFrame, tested: DataFrame, cfg: T.TfidfConfig, key: str, label: str,
                   max_iter: int) -> DataFrame:
    n_train = counted.count()
    vocab = _vocabulary(counted, key, cfg, n_train)
    frame = LR.training_frame(materialize(_frame(counted, vocab, key, {"label": label})), n_train)
    model = LR.fit_logreg(frame, n_train, max_iter)
    frame.unpersist()
    test_label = label if label in tested.columns else "label"
    ev = LR.evaluate(model, _frame(tested, vocab, key, {"label": test_label}), key)
    return ev.select(F.lit(n_train).cast("bigint").alias("n_train"), "*")


def impact(spark: SparkSession, sf: str, seed: int = SEED, rate: float = RATE,
           cfg: T.TfidfConfig = T.EXPERIMENT, max_iter: int = 1000,
           dataset_name: str = "documents+labels") -> DataFrame:
    """The results document as one nested row.

    Flips leave text unchanged, so both models share one frame: the training
    texts are tokenised once, with both label columns carried on the row."""
    train, test = splits(corpus(spark, sf), "row_id", TEST_RATE, seed)
    flipped = X.flip_labels(train, "row_id", "label", rate, seed)
    counted = stored(T.counts(spread(flipped), "row_id", "text", cfg,
                              ["label", "original_label", "is_poisoned"]), "counts")
    n_train = counted.count()
    vocab = _vocabulary(counted, "row_id", cfg, n_train)
    frame = LR.training_frame(materialize(_frame(
        counted, vocab, "row_id", {"clean_label": "original_label", "poisoned_label": "label"})), n_train)
    # the two fits and the test frame (which needs only the fitted vocabulary)
    # are independent jobs: run them side by side
    clean_m, pois_m, test_frame = LR.fit_concurrently([
        (LR.fit_logreg, frame, n_train, max_iter, LR.LR_TOL, "clean_label"),
        (LR.fit_logreg, frame, n_train, max_iter, LR.LR_TOL, "poisoned_label"),
        (lambda: materialize(_frame(stored(T.counts(test, "row_id", "text", cfg, ["label"]), "counts"), vocab,
                                    "row_id", {"label": "label"})),)])
    frame.unpersist()
    c, p = LR.fit_concurrently([(lambda m: LR.evaluate(m, test_frame).first(), clean_m),
                                (lambda m: LR.evaluate(m, test_frame).first(), pois_m)])
    n_poisoned = counted.agg(F.sum("is_poisoned")).first()[0] or 0
    row = {
        "config": (dataset_name, "TF-IDF + Logistic Regression", n_train, int(c["n_test"]),
                   int(n_poisoned), seed, cfg.max_features),
        "clean_model": (float(c["accuracy"]), float(c["f1"])),
        "poisoned_model": (float(p["accuracy"]), float(p["f1"])),
        "impact": (float(c["accuracy"]) - float(p["accuracy"]), float(c["f1"]) - float(p["f1"])),
    }
    schema = ("config struct<dataset_name string, model_name string, train_samples bigint, "
              "test_samples bigint, poisoned_samples bigint, random_state int, max_features int>, "
              "clean_model struct<accuracy double, f1 double>, "
              "poisoned_model struct<accuracy double, f1 double>, "
              "impact struct<accuracy_drop double, f1_drop double>")
    # a one-row summary of model metrics: scalars from three small jobs
    return spark.createDataFrame([tuple(row.values())], schema)


def fitted_model(spark: SparkSession, sf: str, poisoned: bool, seed: int = SEED, rate: float = RATE,
                 cfg: T.TfidfConfig = T.EXPERIMENT) -> DataFrame:
    """M6/M7: intercept and mean held-out probability of one fitted model (the
    real-valued part that predicted classes hide), one row."""
    train, test = splits(corpus(spark, sf), "row_id", TEST_RATE, seed)
    flipped = X.flip_labels(train, "row_id", "label", rate, seed)
    counted = stored(T.counts(spread(flipped), "row_id", "text", cfg, ["label", "original_label"]), "counts")
    n_train = counted.count()
    vocab = _vocabulary(counted, "row_id", cfg, n_train)
    label = "label" if poisoned else "original_label"
    frame = LR.training_frame(materialize(_frame(counted, vocab, "row_id", {"label": label})), n_train)
    model = LR.fit_logreg(frame, n_train)
    frame.unpersist()
    # written: counting and weighing in one task would be two Python workers a core
    tested = stored(T.counts(test, "row_id", "text", cfg, ["label"]), "counts")
    held = _frame(tested, vocab, "row_id", {"label": "label"})
    return model.transform(held).agg(F.avg(vector_to_array("probability")[1]).alias("mean_probability")) \
        .select(F.lit(n_train).cast("bigint").alias("n_train"), F.lit(model.intercept).alias("intercept"),
                "mean_probability")


def conditions(spark: SparkSession, sf: str, seed: int = SEED, rate: float = RATE,
               cfg: T.TfidfConfig = T.MITIGATION, max_iter: int = 1000,
               mitigate_by: str = "is_poisoned") -> DataFrame:
    """Recovery experiment: ``(condition, n_train, n_test, accuracy, f1)`` for
    clean, poisoned and mitigated training sets. ``mitigate_by='is_poisoned'``
    removes the known flips (the reference; an upper bound).

    Training and test texts are tokenised once for all three conditions; each
    condition fits its own vocabulary and model on the shared counts."""
    train, test = splits(corpus(spark, sf), "row_id", TEST_RATE, seed)
    flipped = X.flip_labels(train, "row_id", "label", rate, seed)
    carry = list(dict.fromkeys(["label", "original_label", "is_poisoned", mitigate_by]))
    counted = stored(T.counts(spread(flipped), "row_id", "text", cfg, carry), "counts")
    tested = stored(T.counts(spread(test), "row_id", "text", cfg, ["label"]), "counts")

    def one(name: str, rows: DataFrame, label: str) -> DataFrame:
        r = _fit_and_score(rows, tested, cfg, "row_id", label, max_iter)
        return materialize(r.select(F.lit(name).alias("condition"), "n_train", "n_test", "accuracy", "f1"))

    # independent fits over the same stored counts: run them as concurrent jobs
    parts = LR.fit_concurrently([(one, "clean", counted, "original_label"),
                                 (one, "poisoned", counted, "label"),
                                 (one, "mitigated", X.mitigate(counted, mitigate_by), "label")])
    return reduce(DataFrame.unionByName, parts)


def recovery(cond: DataFrame) -> DataFrame:
    """M9 + M10 over the conditions table: drops (clean - poisoned) and
    recovery (mitigated - poisoned), one row, via a fixed-value pivot."""
    wide = cond.groupBy().pivot("condition", ["clean", "poisoned", "mitigated"]).agg(
        F.first("accuracy").alias("accuracy"), F.first("f1").alias("f1"), F.first("n_train").alias("n"))
    return wide.select(
        F.col("clean_accuracy"), F.col("poisoned_accuracy"), F.col("mitigated_accuracy"),
        F.col("clean_f1"), F.col("poisoned_f1"), F.col("mitigated_f1"),
        (F.col("clean_accuracy") - F.col("poisoned_accuracy")).alias("accuracy_drop"),
        (F.col("clean_f1") - F.col("poisoned_f1")).alias("f1_drop"),
        (F.col("mitigated_accuracy") - F.col("poisoned_accuracy")).alias("accuracy_recovery"),
        (F.col("mitigated_f1") - F.col("poisoned_f1")).alias("f1_recovery"),
        F.col("clean_n").alias("clean_samples"), F.col("poisoned_n").alias("poisoned_samples"),
        F.col("mitigated_n").alias("mitigated_samples"))


def recovery_record(cond: DataFrame) -> DataFrame:
    """M11 for the recovery experiment: the nested results document
    (``experiment, clean, poisoned, mitigated, impact, dataset``)."""
    wide = cond.groupBy().pivot("condition", ["clean", "poisoned", "mitigated"]).agg(
        F.first("accuracy").alias("accuracy"), F.first("f1").alias("f1"),
        F.first("n_train").alias("n"), F.first("n_test").alias("t"))
    pair = lambda c: F.struct(F.col(f"{c}_accuracy").alias("accuracy"), F.col(f"{c}_f1").alias("f1"))
    diff = lambda a, b, m: (F.col(f"{a}_{m}") - F.col(f"{b}_{m}"))
    return wide.select(
        F.lit("mitigation").alias("experiment"), pair("clean").alias("clean"),
        pair("poisoned").alias("poisoned"), pair("mitigated").alias("mitigated"),
        F.struct(diff("clean", "poisoned", "accuracy").alias("accuracy_drop"),
                 diff("clean", "poisoned", "f1").alias("f1_drop"),
                 diff("mitigated", "poisoned", "accuracy").alias("accuracy_recovery"),
                 diff("mitigated", "poisoned", "f1").alias("f1_recovery")).alias("impact"),
        F.struct(F.col("clean_n").alias("clean_samples"), F.col("poisoned_n").alias("poisoned_samples"),
                 F.col("mitigated_n").alias("mitigated_samples"),
                 F.coalesce("clean_t", "poisoned_t", "mitigated_t").alias("test_samples")).alias("dataset"))
