"""Registered queries whose results depend on fitted models (isolation
forest, logistic regression) or on file metadata. The forest's draws are
hashes, so its oracle grows the same trees in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsift.operators import poison as X
from labelsift.operators.scan import scan
from labelsift.plans import detect as D
from labelsift.plans import experiment as E
from labelsift.operators import tfidf as T
from labelsift.plans.common import CORPUS_SQL, RATE, SEED, docs, poisoned_sql, r6, strip_sql
from labelsift.plans.forest_sql import flags_sql, scores_sql
from labelsift.plans.logreg_sql import confusion_sql, scores_of
from labelsift.plans.text_queries import MITIGATED_SQL, TEST_SQL, TRAIN_SQL
from labelsift.sources.artifacts import artifact_manifest


def _detected(spark, sf):
    p = D.poisoned_corpus(spark, sf)
    return p, D.detect(p)


def q_iforest_scores(spark, sf):
    _, det = _detected(spark, sf)
    return r6(det.scores.select("row_id", "score"))


def q_iforest_flags(spark, sf):
    _, det = _detected(spark, sf)
    return r6(det.scores.select("row_id", "anomaly_score", "detector_flag"))


def q_detection_output(spark, sf):
    p, det = _detected(spark, sf)
    return r6(D.detection_output(p, det))


def q_detection_metrics(spark, sf):
    p, det = _detected(spark, sf)
    return r6(D.detection_record(p, det))


def q_mitigate_by_detector(spark, sf):
    """P9 with the detector's flags instead of the known flips: the rows a
    deployed screen would keep (the reference's mitigation is an upper bound)."""
    p, det = _detected(spark, sf)
    return r6(X.mitigate(D.detection_output(p, det), "detector_flag"))


def q_logreg_impact(spark, sf):
    """The impact document's fields as columns."""
    d = E.impact(spark, sf)
    return r6(d.select("config.train_samples", "config.test_samples", "config.poisoned_samples",
                       *[F.col(f"{m}.{x}").alias(f"{m}_{x}") for m in ("clean_model", "poisoned_model")
                         for x in ("accuracy", "f1")], "impact.accuracy_drop", "impact.f1_drop"))


def q_logreg_fit(spark, sf):
    """Real-valued results of the two fits at 2 decimals (what the solver tolerance
    supports)."""
    rows = [E.fitted_model(spark, sf, poisoned).select(F.lit(name).alias("model"), "*")
            for name, poisoned in (("clean", False), ("poisoned", True))]
    return r6(rows[0].unionByName(rows[1]), 2)


def q_logreg_conditions(spark, sf):
    return r6(E.conditions(spark, sf))


def q_logreg_recovery(spark, sf):
    return r6(E.recovery(E.conditions(spark, sf)))


def _scan(spark, sf):
    return scan(docs(spark, sf).select("doc_id", "text", "lang", "source"), key="doc_id")


def q_dataset_scan(spark, sf):
    s = _scan(spark, sf)
    return r6(s.scored.select("doc_id", "anomaly_score", "potentially_suspicious"))


def q_scan_metrics(spark, sf):
    return r6(_scan(spark, sf).metrics)


def q_scan_truth_metrics(spark, sf):
    """M12 on a table with verified ground truth: the poisoned corpus (P12 finds
    its ``is_poisoned`` column), so precision, recall and F1 are reported."""
    p = D.poisoned_corpus(spark, sf)
    return r6(scan(p, key="row_id").metrics)


def q_scan_flagged_display(spark, sf):
    return _scan(spark, sf).display


def q_conversation_scan(spark, sf):
    """M12 with P3 + P8: no key and no text column named by the caller; the
    text column is resolved from the schema and ``source_row`` is attached in
    file order."""
    conv = spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet").select("role", "text")
    s = scan(conv)
    return r6(s.scored.select("source_row", "role", "anomaly_score", "potentially_suspicious"))


def q_artifact_manifest(spark, sf):
    names = ["documents", "labels", "conversations"]
    expected = {n: f"{sf.rstrip('/')}/{n}.parquet" for n in names}
    expected["detection_results"] = f"{sf.rstrip('/')}/detection_results.csv"
    return artifact_manifest(spark, expected).select(
        "artifact", "status", (F.col("size") > 0).alias("has_size"))


QUERIES = {
    "iforest_scores": q_iforest_scores,
    "iforest_flags": q_iforest_flags,
    "detection_output": q_detection_output,
    "detection_metrics": q_detection_metrics,
    "mitigate_by_detector": q_mitigate_by_detector,
    "logreg_impact": q_logreg_impact,
    "logreg_fit": q_logreg_fit,
    "logreg_conditions": q_logreg_conditions,
    "logreg_recovery": q_logreg_recovery,
    "dataset_scan": q_dataset_scan,
    "scan_metrics": q_scan_metrics,
    "scan_truth_metrics": q_scan_truth_metrics,
    "scan_flagged_display": q_scan_flagged_display,
    "conversation_scan": q_conversation_scan,
    "artifact_manifest": q_artifact_manifest,
}

# The forest's draws are hashes, so SQL grows the same trees (forest_sql).
# Flips leave text unchanged: the detect features of the poisoned corpus are
# those of the corpus.
_SCORES_SQL = scores_sql(CORPUS_SQL, T.DETECT)
_POISONED_SQL = poisoned_sql(SEED, RATE, CORPUS_SQL)
# M3: the true poison rate clamped to [0.001, 0.49]
_CONTAMINATION_SQL = (f"SELECT greatest(least(sum(is_poisoned)::DOUBLE / count(*), 0.49), 0.001) AS c "
                      f"FROM ({_POISONED_SQL})")
_FLAGS_SQL = flags_sql(_SCORES_SQL, _CONTAMINATION_SQL)
_JOINED_SQL = f"SELECT p.*, f.detector_flag, f.anomaly_score FROM ({_POISONED_SQL}) p JOIN ({_FLAGS_SQL}) f USING (row_id)"

# M12 on the documents table: non-blank rows, scan TF-IDF, unsupervised
# contamination min(.05, max(1/n, .001)) (M4).
_NONBLANK_SQL = strip_sql("coalesce(CAST(text AS VARCHAR), '')") + " <> ''"
_SCAN_SRC = f"SELECT doc_id, text FROM documents WHERE {_NONBLANK_SQL}"
_SCAN_FLAGS_SQL = flags_sql(
    scores_sql(_SCAN_SRC, T.SCAN, key="doc_id"),
    f"SELECT least(0.05, greatest(1.0 / count(*), 0.001)) AS c FROM ({_SCAN_SRC})", key="doc_id")

_TRUTH_SRC = f"SELECT row_id, text FROM ({CORPUS_SQL}) WHERE {_NONBLANK_SQL}"
_TRUTH_FLAGS_SQL = flags_sql(
    scores_sql(_TRUTH_SRC, T.SCAN),
    f"SELECT least(0.05, greatest(1.0 / count(*), 0.001)) AS c FROM ({_TRUTH_SRC})")

# Spark numbers the conversations rows in file order itself; the driver
# file is stored in (conv_id, turn) order with unique keys (checked at every
# scale), which SQL can state.
_CONV_SRC = (f"SELECT source_row, role, text FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 "
             f"AS source_row, role, text FROM conversations) WHERE {_NONBLANK_SQL}")
_CONV_FLAGS_SQL = flags_sql(
    scores_sql(_CONV_SRC, T.SCAN, key="source_row"),
    f"SELECT least(0.05, greatest(1.0 / count(*), 0.001)) AS c FROM ({_CONV_SRC})", key="source_row")

_FLIPPED_TRAIN = poisoned_sql(SEED, RATE, TRAIN_SQL)
_CLEAN_LR = scores_of(confusion_sql(TRAIN_SQL, TEST_SQL, T.EXPERIMENT))
_FLIPPED_LR = scores_of(confusion_sql(_FLIPPED_TRAIN, TEST_SQL, T.EXPERIMENT))
_CONDITIONS = " UNION ALL ".join(
    f"SELECT '{name}' AS condition, * FROM ({scores_of(confusion_sql(train, TEST_SQL, T.MITIGATION))})"
    for name, train in (("clean", TRAIN_SQL), ("poisoned", _FLIPPED_TRAIN), ("mitigated", MITIGATED_SQL)))

ORACLE: dict[str, str] = {
    "logreg_impact": f"""
        SELECT c.n_train AS train_samples, c.n_test AS test_samples,
               (SELECT CAST(sum(is_poisoned) AS BIGINT) FROM ({_FLIPPED_TRAIN})) AS poisoned_samples,
               round(c.accuracy, 6) AS clean_model_accuracy, round(c.f1, 6) AS clean_model_f1,
               round(p.accuracy, 6) AS poisoned_model_accuracy, round(p.f1, 6) AS poisoned_model_f1,
               round(c.accuracy - p.accuracy, 6) AS accuracy_drop, round(c.f1 - p.f1, 6) AS f1_drop
        FROM ({_CLEAN_LR}) c, ({_FLIPPED_LR}) p""",
    "logreg_fit": " UNION ALL ".join(
        f"SELECT '{name}' AS model, n_train, round(intercept, 2) AS intercept, "
        f"round(mean_probability, 2) AS mean_probability FROM ({confusion_sql(train, TEST_SQL, T.EXPERIMENT)})"
        for name, train in (("clean", TRAIN_SQL), ("poisoned", _FLIPPED_TRAIN))),
    "logreg_conditions": f"""
        SELECT condition, n_train, n_test, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM ({_CONDITIONS})""",
    "logreg_recovery": f"""
        WITH k AS MATERIALIZED ({_CONDITIONS}),
        c AS (SELECT * FROM k WHERE condition = 'clean'), p AS (SELECT * FROM k WHERE condition = 'poisoned'),
        m AS (SELECT * FROM k WHERE condition = 'mitigated')
        SELECT round(c.accuracy, 6) AS clean_accuracy, round(p.accuracy, 6) AS poisoned_accuracy,
               round(m.accuracy, 6) AS mitigated_accuracy, round(c.f1, 6) AS clean_f1, round(p.f1, 6) AS poisoned_f1,
               round(m.f1, 6) AS mitigated_f1, round(c.accuracy - p.accuracy, 6) AS accuracy_drop,
               round(c.f1 - p.f1, 6) AS f1_drop, round(m.accuracy - p.accuracy, 6) AS accuracy_recovery,
               round(m.f1 - p.f1, 6) AS f1_recovery, c.n_train AS clean_samples, p.n_train AS poisoned_samples,
               m.n_train AS mitigated_samples
        FROM c, p, m""",
    "iforest_scores": f"SELECT row_id, round(score, 6) AS score FROM ({_SCORES_SQL})",
    "iforest_flags": f"SELECT row_id, round(anomaly_score, 6) AS anomaly_score, detector_flag FROM ({_FLAGS_SQL})",
    "detection_output": f"""
        SELECT row_id, text, label, original_label, is_poisoned, detector_flag,
               round(anomaly_score, 6) AS anomaly_score FROM ({_JOINED_SQL})""",
    "detection_metrics": f"""
        SELECT 'Isolation Forest' AS detector, 'TF-IDF' AS feature_extraction, {SEED} AS random_state,
               total AS total_samples, ap AS actual_poisoned, ac AS actual_clean, fl AS flagged_samples,
               round(coalesce(fl / nullif(total, 0), 0.0), 6) AS flag_rate,
               round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
               tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE is_poisoned = 1) AS ap,
                     count(*) FILTER (WHERE is_poisoned = 0) AS ac,
                     count(*) FILTER (WHERE detector_flag = 1) AS fl,
                     count(*) FILTER (WHERE is_poisoned = 1 AND detector_flag = 1) AS tp,
                     count(*) FILTER (WHERE is_poisoned = 0 AND detector_flag = 1) AS fp,
                     count(*) FILTER (WHERE is_poisoned = 1 AND detector_flag = 0) AS fn,
                     count(*) FILTER (WHERE is_poisoned = 0 AND detector_flag = 0) AS tn
              FROM ({_JOINED_SQL}))""",
    "mitigate_by_detector": f"""
        SELECT row_id, text, label, original_label, is_poisoned, detector_flag,
               round(anomaly_score, 6) AS anomaly_score FROM ({_JOINED_SQL}) WHERE detector_flag = 0""",
    "dataset_scan": f"""
        SELECT doc_id, round(anomaly_score, 6) AS anomaly_score, detector_flag = 1 AS potentially_suspicious
        FROM ({_SCAN_FLAGS_SQL})""",
    "scan_metrics": f"""
        SELECT total, flagged, round(coalesce(flagged / nullif(total, 0), 0.0), 6) AS flag_rate,
               false AS both_classes, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall,
               CAST(NULL AS DOUBLE) AS f1, 'text' AS text_column, CAST(NULL AS VARCHAR) AS truth_source
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE detector_flag = 1) AS flagged
              FROM ({_SCAN_FLAGS_SQL}))""",
    "scan_truth_metrics": f"""
        SELECT total, flagged, round(flagged / total, 6) AS flag_rate, ap > 0 AND ac > 0 AS both_classes,
               round(CASE WHEN ap > 0 AND ac > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0.0) END, 6) AS precision,
               round(CASE WHEN ap > 0 AND ac > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0.0) END, 6) AS recall,
               round(CASE WHEN ap > 0 AND ac > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) END, 6) AS f1,
               'text' AS text_column, 'is_poisoned column' AS truth_source
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE f.detector_flag = 1) AS flagged,
                     count(*) FILTER (WHERE p.is_poisoned = 1) AS ap, count(*) FILTER (WHERE p.is_poisoned = 0) AS ac,
                     count(*) FILTER (WHERE p.is_poisoned = 1 AND f.detector_flag = 1) AS tp,
                     count(*) FILTER (WHERE p.is_poisoned = 0 AND f.detector_flag = 1) AS fp,
                     count(*) FILTER (WHERE p.is_poisoned = 1 AND f.detector_flag = 0) AS fn
              FROM ({_TRUTH_FLAGS_SQL}) f JOIN ({_POISONED_SQL}) p USING (row_id))""",
    "scan_flagged_display": f"""
        SELECT f.doc_id AS source_row,
               CASE WHEN length(d.text) > 180 THEN substr(d.text, 1, 177) || '...' ELSE d.text END AS text,
               round(f.anomaly_score, 4) AS anomaly_score
        FROM ({_SCAN_FLAGS_SQL}) f JOIN documents d USING (doc_id)
        WHERE f.detector_flag = 1 ORDER BY f.anomaly_score DESC, f.doc_id LIMIT 100""",
    "conversation_scan": f"""
        SELECT f.source_row, c.role, round(f.anomaly_score, 6) AS anomaly_score,
               f.detector_flag = 1 AS potentially_suspicious
        FROM ({_CONV_FLAGS_SQL}) f JOIN ({_CONV_SRC}) c USING (source_row)""",
}
