"""Registered queries for profiling, poisoning, mitigation and scoring
(build-plan steps 1-2), with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsift.functions.columns import nonblank, truncate_display
from labelsift.operators import metrics as M
from labelsift.operators import poison as X
from labelsift.operators import profile as A
from labelsift.plans.common import (
    CORPUS_SQL, RATE, SEED, corpus, docs, hash60_sql, poisoned_sql, r6,
    standin_flag_sql, strip_sql,
)
from labelsift.session import stored
from labelsift.sources.corpus import train_test_split

# ---------------------------------------------------------------- step 1


def q_profile_overview(spark, sf):
    return A.overview(corpus(spark, sf))


def q_label_distribution(spark, sf):
    return A.label_distribution(corpus(spark, sf))


def q_missing_values(spark, sf):
    return A.missing_values(docs(spark, sf))


def q_duplicate_texts(spark, sf):
    return A.duplicate_count(docs(spark, sf), "text")


def q_text_length_stats(spark, sf):
    return r6(A.length_stats(docs(spark, sf), "text"))


def q_sample_rows(spark, sf):
    return A.head_rows(corpus(spark, sf), "row_id", 5)


def q_sample_texts(spark, sf):
    return A.sample_texts(corpus(spark, sf))


def q_corpus_projection(spark, sf):
    return corpus(spark, sf)


def q_train_test_split(spark, sf):
    return train_test_split(corpus(spark, sf), "row_id", 0.5, SEED).select("row_id", "label", "split")


def q_nonblank_rows(spark, sf):
    d = docs(spark, sf)
    return d.where(nonblank("text")).select(F.col("doc_id").alias("source_row"), "text")


def _poisoned(spark, sf):
    return X.flip_labels(corpus(spark, sf), "row_id", "label", RATE, SEED)


def q_poison_flip(spark, sf):
    return _poisoned(spark, sf)


def q_poison_index(spark, sf):
    return X.poison_index(_poisoned(spark, sf))


def q_poison_summary(spark, sf):
    return r6(X.poison_summary(_poisoned(spark, sf)))


def q_mitigate_drop(spark, sf):
    return X.mitigate(_poisoned(spark, sf), "is_poisoned")


def q_mitigation_counts(spark, sf):
    return X.mitigation_counts(_poisoned(spark, sf), "is_poisoned")


def q_poisoned_semi_join(spark, sf):
    c = corpus(spark, sf)
    return X.poisoned_rows(c, X.poison_index(_poisoned(spark, sf)))


def q_clean_anti_join(spark, sf):
    c = corpus(spark, sf)
    return X.clean_rows(c, X.poison_index(_poisoned(spark, sf)))


# ---------------------------------------------------------------- step 2
# Detection metrics are scored against a stand-in detector flag (an exact
# seeded draw) so that each metric is checked in isolation; the forest's own
# flags are scored by the detect plan (model_queries).


def _flagged(spark, sf):
    return X.mark_draw(_poisoned(spark, sf), "row_id", RATE, f"flag:{SEED}", "detector_flag")


def q_confusion_matrix(spark, sf):
    return M.confusion(_flagged(spark, sf))


def q_confusion_pivot(spark, sf):
    return M.confusion_pivot(_flagged(spark, sf))


def q_precision_recall_f1(spark, sf):
    return r6(M.score_flags(_flagged(spark, sf)))


def q_gated_scores(spark, sf):
    return r6(M.gated_scores(_flagged(spark, sf), "is_poisoned", "detector_flag"))


def q_ground_truth_norm(spark, sf):
    p = _poisoned(spark, sf)
    return p.select("row_id", M.truth_from_flag("is_poisoned").alias("truth_flag"),
                    M.truth_from_labels("original_label", "label").alias("truth_labels"))


def q_contamination(spark, sf):
    p = _poisoned(spark, sf)
    n_docs = docs(spark, sf).count()
    s = M.score_flags(p.withColumn("_f", F.lit(0)), "is_poisoned", "_f")
    return r6(s.select(F.col("poison_rate"),
                       M.contamination_supervised(F.col("poison_rate")).alias("contamination_supervised"),
                       M.contamination_unsupervised(F.lit(n_docs)).alias("contamination_unsupervised")))


def _length_scored(spark, sf):
    """Scores by text length, written once: the percentile and histogram passes
    read the score column alone, never the text again."""
    d = docs(spark, sf).select("doc_id", "text", F.char_length("text").cast("double").alias("score"))
    return stored(d, "lengths")


def q_score_histogram(spark, sf):
    return r6(M.histogram(_length_scored(spark, sf).select("score"), "score", 30))


def _threshold(spark, sf):
    d = _length_scored(spark, sf)
    n = d.count()
    c = d.sparkSession.range(1).select(M.contamination_unsupervised(F.lit(n))).first()[0]
    return M.flag_by_contamination(d, "score", c, "flag", "anomaly_score")


def q_threshold_flags(spark, sf):
    return r6(_threshold(spark, sf).select("doc_id", "anomaly_score", "flag"))


def q_flagged_top100(spark, sf):
    t = _threshold(spark, sf).where(F.col("flag") == 1)
    return (t.orderBy(F.desc("anomaly_score"), "doc_id").limit(100)
             .select(F.col("doc_id").alias("source_row"),
                     truncate_display("text", 180).alias("text"),
                     F.round("anomaly_score", 4).alias("anomaly_score")))


QUERIES = {
    "profile_overview": q_profile_overview,
    "label_distribution": q_label_distribution,
    "missing_values": q_missing_values,
    "duplicate_texts": q_duplicate_texts,
    "text_length_stats": q_text_length_stats,
    "sample_rows": q_sample_rows,
    "sample_texts": q_sample_texts,
    "corpus_projection": q_corpus_projection,
    "train_test_split": q_train_test_split,
    "nonblank_rows": q_nonblank_rows,
    "poison_flip": q_poison_flip,
    "poison_index": q_poison_index,
    "poison_summary": q_poison_summary,
    "mitigate_drop": q_mitigate_drop,
    "mitigation_counts": q_mitigation_counts,
    "poisoned_semi_join": q_poisoned_semi_join,
    "clean_anti_join": q_clean_anti_join,
    "confusion_matrix": q_confusion_matrix,
    "confusion_pivot": q_confusion_pivot,
    "precision_recall_f1": q_precision_recall_f1,
    "gated_scores": q_gated_scores,
    "ground_truth_norm": q_ground_truth_norm,
    "contamination": q_contamination,
    "score_histogram": q_score_histogram,
    "threshold_flags": q_threshold_flags,
    "flagged_top100": q_flagged_top100,
}

# ---------------------------------------------------------------- oracle SQL

_P = poisoned_sql()
_F = standin_flag_sql(SEED, RATE, _P)
_SCORED = "SELECT doc_id, text, CAST(length(text) AS DOUBLE) AS score FROM documents"
_THRESH = f"""
    WITH s AS ({_SCORED}),
    n AS (SELECT count(*) AS n, least(0.05, greatest(1.0 / count(*), 0.001)) AS c FROM s),
    r AS (SELECT -score AS v, row_number() OVER (ORDER BY -score) - 1 AS rk FROM s),
    p AS (SELECT c * (n - 1) AS pos, floor(c * (n - 1)) AS lo, n FROM n),
    o AS (SELECT (SELECT v FROM r WHERE rk = p.lo) AS a,
                 (SELECT v FROM r WHERE rk = least(p.lo + 1, p.n - 1)) AS b,
                 p.pos - p.lo AS t FROM p),
    off AS (SELECT a + (b - a) * t AS off FROM o)
    SELECT s.doc_id, s.text, s.score + off.off AS anomaly_score,
           CASE WHEN s.score + off.off > 0 THEN 1 ELSE 0 END AS flag
    FROM s, off"""
_PRF = """
    SELECT total, actual_poisoned, actual_clean, flagged, tn, fp, fn, tp,
           round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
           round(coalesce(flagged / nullif(total, 0), 0), 6) AS flag_rate,
           round(coalesce(actual_poisoned / nullif(total, 0), 0), 6) AS poison_rate
    FROM (SELECT count(*) AS total,
                 count(*) FILTER (WHERE is_poisoned = 1) AS actual_poisoned,
                 count(*) FILTER (WHERE is_poisoned = 0) AS actual_clean,
                 count(*) FILTER (WHERE detector_flag = 1) AS flagged,
                 count(*) FILTER (WHERE is_poisoned = 0 AND detector_flag = 0) AS tn,
                 count(*) FILTER (WHERE is_poisoned = 0 AND detector_flag = 1) AS fp,
                 count(*) FILTER (WHERE is_poisoned = 1 AND detector_flag = 0) AS fn,
                 count(*) FILTER (WHERE is_poisoned = 1 AND detector_flag = 1) AS tp
          FROM ({flagged}))"""

ORACLE = {
    "profile_overview": f"SELECT count(*) AS n_rows, 3 AS n_columns, 'row_id,text,label' AS columns FROM ({CORPUS_SQL})",
    "label_distribution": f"SELECT label, count(*) AS n FROM ({CORPUS_SQL}) WHERE label IS NOT NULL GROUP BY label",
    "missing_values": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "duplicate_texts": "SELECT count(*) - count(DISTINCT text) - max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n_duplicates FROM documents",
    "text_length_stats": "SELECT round(avg(length(text)), 2) AS avg_chars, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars FROM documents",
    "sample_rows": f"SELECT * FROM ({CORPUS_SQL}) ORDER BY row_id LIMIT 5",
    "sample_texts": f"SELECT row_id, substr(text, 1, 300) AS text_head, label FROM ({CORPUS_SQL}) ORDER BY row_id LIMIT 3",
    "corpus_projection": CORPUS_SQL,
    "train_test_split": f"SELECT row_id, label, CASE WHEN {hash60_sql(str(SEED), 'row_id')} < {int(0.5 * (1 << 60))} THEN 'test' ELSE 'train' END AS split FROM ({CORPUS_SQL})",
    "nonblank_rows": f"SELECT doc_id AS source_row, text FROM documents WHERE {strip_sql('coalesce(CAST(text AS VARCHAR), \'\')')} <> ''",
    "poison_flip": _P,
    "poison_index": f"SELECT row_id FROM ({_P}) WHERE is_poisoned = 1",
    "poison_summary": f"""
        SELECT label, n_label, total, n_poisoned, n_clean, round(coalesce(n_poisoned / nullif(total, 0), 0), 6) AS poison_rate
        FROM (SELECT label, count(*) AS n_label FROM ({_P}) WHERE label IS NOT NULL GROUP BY label) h,
             (SELECT count(*) AS total, count(*) FILTER (WHERE is_poisoned = 1) AS n_poisoned,
                     count(*) FILTER (WHERE is_poisoned = 0) AS n_clean FROM ({_P})) t""",
    "mitigate_drop": f"SELECT * FROM ({_P}) WHERE is_poisoned = 0",
    "mitigation_counts": f"""
        SELECT count(*) AS n_loaded, CAST(coalesce(sum(is_poisoned), 0) AS BIGINT) AS n_identified,
               count(*) FILTER (WHERE NOT (is_poisoned = 0) OR is_poisoned IS NULL) AS n_removed,
               count(*) FILTER (WHERE is_poisoned = 0) AS n_remaining FROM ({_P})""",
    "poisoned_semi_join": f"SELECT * FROM ({CORPUS_SQL}) c WHERE row_id IN (SELECT row_id FROM ({_P}) WHERE is_poisoned = 1)",
    "clean_anti_join": f"SELECT * FROM ({CORPUS_SQL}) c WHERE row_id NOT IN (SELECT row_id FROM ({_P}) WHERE is_poisoned = 1)",
    "confusion_matrix": f"""
        SELECT count(*) FILTER (WHERE is_poisoned = 0 AND detector_flag = 0) AS tn,
               count(*) FILTER (WHERE is_poisoned = 0 AND detector_flag = 1) AS fp,
               count(*) FILTER (WHERE is_poisoned = 1 AND detector_flag = 0) AS fn,
               count(*) FILTER (WHERE is_poisoned = 1 AND detector_flag = 1) AS tp FROM ({_F})""",
    "confusion_pivot": f"""
        SELECT CAST(is_poisoned AS INTEGER) AS actual,
               count(*) FILTER (WHERE detector_flag = 0) AS pred_0,
               count(*) FILTER (WHERE detector_flag = 1) AS pred_1
        FROM ({_F}) WHERE is_poisoned IN (0, 1) AND detector_flag IN (0, 1) GROUP BY is_poisoned""",
    "precision_recall_f1": _PRF.format(flagged=_F),
    "gated_scores": f"""
        SELECT total, flagged, flag_rate, both_classes,
               CASE WHEN both_classes THEN precision END AS precision,
               CASE WHEN both_classes THEN recall END AS recall,
               CASE WHEN both_classes THEN f1 END AS f1
        FROM (SELECT *, actual_poisoned > 0 AND actual_clean > 0 AS both_classes
              FROM ({_PRF.format(flagged=_F)}))""",
    "ground_truth_norm": f"""
        SELECT row_id,
               CASE WHEN lower({strip_sql('CAST(is_poisoned AS VARCHAR)')}) IN ({", ".join(repr(w) for w in M.TRUTHY)}) THEN 1 ELSE 0 END AS truth_flag,
               CASE WHEN {strip_sql('CAST(original_label AS VARCHAR)')} IS NOT DISTINCT FROM {strip_sql('CAST(label AS VARCHAR)')} THEN 0 ELSE 1 END AS truth_labels
        FROM ({_P})""",
    "contamination": f"""
        SELECT round(pr, 6) AS poison_rate, round(greatest(least(pr, 0.49), 0.001), 6) AS contamination_supervised,
               round(least(0.05, greatest(1.0 / nd, 0.001)), 6) AS contamination_unsupervised
        FROM (SELECT coalesce(count(*) FILTER (WHERE is_poisoned = 1) / nullif(count(*), 0), 0) AS pr FROM ({_P})),
             (SELECT count(*) AS nd FROM documents)""",
    "score_histogram": f"""
        WITH s AS ({_SCORED}), m AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
        b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((score - lo) / (hi - lo) * 30), 29) AS INTEGER) END AS bin,
                     lo, CASE WHEN hi = lo THEN 0.0 ELSE (hi - lo) / 30 END AS w FROM s, m)
        SELECT bin, round(min(lo) + bin * min(w), 6) AS bin_lo, round(min(lo) + (bin + 1) * min(w), 6) AS bin_hi, count(*) AS n
        FROM b GROUP BY bin""",
    "threshold_flags": f"SELECT doc_id, round(anomaly_score, 6) AS anomaly_score, flag FROM ({_THRESH})",
    "flagged_top100": f"""
        SELECT doc_id AS source_row,
               CASE WHEN length(text) > 180 THEN substr(text, 1, 177) || '...' ELSE text END AS text,
               round(anomaly_score, 4) AS anomaly_score
        FROM ({_THRESH}) WHERE flag = 1 ORDER BY anomaly_score DESC, doc_id LIMIT 100""",
}
