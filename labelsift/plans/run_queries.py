"""Registered queries for the run-level operators (build-plan step 6).

Their input is a per-seed runs table derived from the corpus for seeds
1, 2, 3: seeded split, exact 5 % flip of the training split, a stand-in
detector flag (exact seeded draw) and a majority-class stand-in model for the
clean and poisoned training labels. Every number in it has an exact SQL
oracle; the runs produced by the real models come from ``model_queries``.
All seeds' rows come from one conditional aggregation over keys and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsift.functions.columns import hash60, safe_div
from labelsift.operators import poison as X
from labelsift.operators import runs as R
from labelsift.plans.common import CORPUS_SQL, RATE, corpus, hash60_sql, poisoned_sql, r6, standin_flag_sql
from labelsift.session import materialize, run_concurrently
from labelsift.sources.corpus import train_test_split

SEEDS = (1, 2, 3)
TEST_RATE = 0.5
_CUT = int(TEST_RATE * (1 << 60))


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


def _seed_counts(c: DataFrame, seeds: tuple) -> DataFrame:
    """One row of counts per seed. The keys and labels are written once, without
    texts; each seed's two exact draws are fitted on them side by side, and all
    seeds are counted in one pass of row-local predicates."""
    keys = materialize(c.select("row_id", "label"))

    def draws(s: int):
        train = train_test_split(keys, "row_id", TEST_RATE, s).where(F.col("split") == "train")
        return X.draw(train, "row_id", RATE, s), X.draw(train, "row_id", RATE, f"flag:{s}")

    aggs = []
    for s, (flip, flag) in zip(seeds, run_concurrently([(draws, s) for s in seeds])):
        te = hash60(s, "row_id") < F.lit(_CUT)
        tr, one, zero = ~te, F.col("label") == 1, F.col("label") == 0
        p, f = flip.predicate("row_id"), flag.predicate("row_id")
        counts = {"tr1": tr & one, "tr0": tr & zero, "te1": te & one, "te0": te & zero,
                  # a flip turns 0 into 1 and 1 into 0
                  "pr1": tr & ((~p & one) | (p & zero)), "pr0": tr & ((~p & zero) | (p & one)),
                  "mr1": tr & ~p & one, "mr0": tr & ~p & zero, "flagged": tr & f,
                  "tp": tr & p & f, "fp": tr & ~p & f, "fn": tr & p & ~f, "tn": tr & ~p & ~f}
        aggs.append(F.struct(F.lit(s).alias("seed"), *[_cnt(x).alias(n) for n, x in counts.items()]))
    return keys.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def _seed_rows(c: DataFrame, seeds: tuple, with_conditions: bool = False) -> DataFrame:
    a = _seed_counts(c, seeds)

    def model(n1, n0):
        maj1 = F.col(n1) >= F.col(n0)
        te1, te0 = F.col("te1"), F.col("te0")
        acc = F.when(maj1, safe_div(te1, te1 + te0)).otherwise(safe_div(te0, te1 + te0))
        f1 = F.when(maj1, safe_div(2 * te1, 2 * te1 + te0)).otherwise(F.lit(0.0))
        return F.struct(acc.alias("accuracy"), f1.alias("f1"))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    det = F.struct(F.col("flagged").alias("n_flagged"),
                   safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"),
                   safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                   F.struct(tp.alias("true_positive"), fp.alias("false_positive"),
                            fn.alias("false_negative"), F.col("tn").alias("true_negative"))
                   .alias("confusion_matrix"))
    cols = [F.col("seed"), model("tr1", "tr0").alias("clean"),
            model("pr1", "pr0").alias("poisoned"), det.alias("detection")]
    if with_conditions:
        n = F.col("tr1") + F.col("tr0")
        cols += [model("mr1", "mr0").alias("mitigated"), n.alias("n_clean"),
                 (F.col("mr1") + F.col("mr0")).alias("n_mitigated"), (F.col("te1") + F.col("te0")).alias("n_test")]
    return a.select(*cols)


def standin_runs(spark, sf, seeds=SEEDS) -> DataFrame:
    return _seed_rows(corpus(spark, sf), tuple(seeds))


def _doc(spark, sf) -> DataFrame:
    """A results document (no ``runs``) whose sections come from seed 1."""
    r = _seed_rows(corpus(spark, sf), (1,))
    return r.select(
        F.struct(F.lit(1).alias("random_state")).alias("config"),
        F.col("clean").alias("clean_model"), F.col("poisoned").alias("poisoned_model"),
        F.struct((F.col("clean.accuracy") - F.col("poisoned.accuracy")).alias("accuracy_drop"),
                 (F.col("clean.f1") - F.col("poisoned.f1")).alias("f1_drop")).alias("impact"),
        F.struct(F.col("detection.n_flagged").alias("flagged_samples"),
                 F.col("detection.precision").alias("precision"), F.col("detection.recall").alias("recall"),
                 F.col("detection.f1").alias("f1"), F.col("detection.confusion_matrix").alias("confusion_matrix"),
                 (F.col("detection.confusion_matrix.true_positive")
                  + F.col("detection.confusion_matrix.false_negative")).alias("actual_poisoned"),
                 (F.col("detection.confusion_matrix.true_positive") + F.col("detection.confusion_matrix.false_positive")
                  + F.col("detection.confusion_matrix.false_negative")
                  + F.col("detection.confusion_matrix.true_negative")).alias("total_samples"))
        .alias("detection"))


def _config_doc(spark, sf) -> DataFrame:
    """A results document whose config section is measured on seed 1's run."""
    r = _seed_rows(corpus(spark, sf), (1,), with_conditions=True)
    cm = "detection.confusion_matrix"
    poisoned = F.col(f"{cm}.true_positive") + F.col(f"{cm}.false_negative")
    return r.select(F.struct(
        F.lit("documents+labels").alias("dataset_name"), F.lit("majority class").alias("model_name"),
        F.col("n_clean").alias("train_samples"), F.col("n_test").alias("test_samples"),
        safe_div(poisoned, F.col("n_clean")).alias("poison_rate"), F.lit("label flip").alias("poison_strategy"),
        F.array(*[F.lit(s) for s in SEEDS]).alias("seeds"), F.lit("seeded draw").alias("detector"),
        safe_div(F.col("detection.n_flagged"), F.col("n_clean")).alias("detector_contamination")).alias("config"))


def _summary_doc(spark, sf) -> DataFrame:
    """The seed-1 document with a raw summary section: one entry of a name that
    normalisation does not know (kept) and one that it overwrites."""
    d = _doc(spark, sf)
    return d.withColumn("summary", F.struct(
        F.struct(F.col("detection.total_samples").cast("double").alias("mean")).alias("rows_seen"),
        F.lit(-1.0).alias("clean_accuracy")))


def _merged_summary(spark, sf) -> DataFrame:
    m = R.merged_summary(_summary_doc(spark, sf))
    return r6(m.withColumn("rows_seen", F.col("rows_seen.mean")))


def standin_conditions(spark, sf, seed: int = 1) -> DataFrame:
    """Conditions table ``(condition, n_train, n_test, accuracy, f1)`` of the
    stand-in model for clean, poisoned and mitigated training labels."""
    r = _seed_rows(corpus(spark, sf), (seed,), with_conditions=True)
    rows = [F.struct(F.lit(name).alias("condition"), F.col(n).alias("n_train"), F.col("n_test"),
                     F.col(f"{name}.accuracy").alias("accuracy"), F.col(f"{name}.f1").alias("f1"))
            for name, n in (("clean", "n_clean"), ("poisoned", "n_clean"), ("mitigated", "n_mitigated"))]
    return r.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def _recovery(spark, sf):
    from labelsift.plans.experiment import recovery
    return r6(recovery(standin_conditions(spark, sf)))


QUERIES = {
    "impact_recovery": _recovery,
    "config_table": lambda spark, sf: R.config_rows(_config_doc(spark, sf)),
    "summary_merged": _merged_summary,
    "run_export": lambda spark, sf: r6(R.run_export(standin_runs(spark, sf))),
    "seed_runs": lambda spark, sf: r6(R.run_rows(standin_runs(spark, sf))),
    "run_table": lambda spark, sf: r6(R.run_table(standin_runs(spark, sf))),
    "impact_table": lambda spark, sf: r6(R.impact_table(standin_runs(spark, sf))),
    "detection_audit": lambda spark, sf: r6(R.detection_audit(standin_runs(spark, sf))),
    "run_matrix": lambda spark, sf: r6(R.run_matrix(standin_runs(spark, sf))),
    "run_stats": lambda spark, sf: r6(R.run_stats(standin_runs(spark, sf))),
    "impact_mean_std": lambda spark, sf: r6(R.impact_mean_std(standin_runs(spark, sf))),
    "metric_resolution": lambda spark, sf: r6(R.normalise_results(_doc(spark, sf))),
    "runs_synthesised": lambda spark, sf: r6(R.run_rows(R.runs_of(_doc(spark, sf)))),
}

# ---------------------------------------------------------------- oracle SQL


def _seed_sql(s: int) -> str:
    train = f"SELECT * FROM ({CORPUS_SQL}) WHERE {hash60_sql(str(s), 'row_id')} >= {_CUT}"
    test = f"SELECT * FROM ({CORPUS_SQL}) WHERE {hash60_sql(str(s), 'row_id')} < {_CUT}"
    f = standin_flag_sql(s, RATE, poisoned_sql(s, RATE, train))
    agg = f"""
      SELECT count(*) FILTER (WHERE sp = 'train' AND original_label = 1) AS tr1,
             count(*) FILTER (WHERE sp = 'train' AND original_label = 0) AS tr0,
             count(*) FILTER (WHERE sp = 'train' AND label = 1) AS pr1,
             count(*) FILTER (WHERE sp = 'train' AND label = 0) AS pr0,
             count(*) FILTER (WHERE sp = 'train' AND is_poisoned = 0 AND label = 1) AS mr1,
             count(*) FILTER (WHERE sp = 'train' AND is_poisoned = 0 AND label = 0) AS mr0,
             count(*) FILTER (WHERE sp = 'test' AND label = 1) AS te1,
             count(*) FILTER (WHERE sp = 'test' AND label = 0) AS te0,
             count(*) FILTER (WHERE sp = 'train' AND detector_flag = 1) AS flagged,
             count(*) FILTER (WHERE sp = 'train' AND is_poisoned = 1 AND detector_flag = 1) AS tp,
             count(*) FILTER (WHERE sp = 'train' AND is_poisoned = 0 AND detector_flag = 1) AS fp,
             count(*) FILTER (WHERE sp = 'train' AND is_poisoned = 1 AND detector_flag = 0) AS fn,
             count(*) FILTER (WHERE sp = 'train' AND is_poisoned = 0 AND detector_flag = 0) AS tn
      FROM (SELECT 'train' AS sp, label, original_label, is_poisoned, detector_flag FROM ({f})
            UNION ALL
            SELECT 'test' AS sp, label, NULL, NULL, NULL FROM ({test}))"""

    def acc(n1, n0):
        return (f"CASE WHEN {n1} >= {n0} THEN coalesce(te1 / nullif(te1 + te0, 0), 0) "
                f"ELSE coalesce(te0 / nullif(te1 + te0, 0), 0) END")

    def f1(n1, n0):
        return f"CASE WHEN {n1} >= {n0} THEN coalesce(2 * te1 / nullif(2 * te1 + te0, 0), 0) ELSE 0.0 END"

    return f"""
      SELECT {s} AS seed, {acc('tr1', 'tr0')} AS clean_accuracy, {f1('tr1', 'tr0')} AS clean_f1,
             {acc('pr1', 'pr0')} AS poisoned_accuracy, {f1('pr1', 'pr0')} AS poisoned_f1,
             CAST(flagged AS DOUBLE) AS n_flagged,
             {acc('mr1', 'mr0')} AS mitigated_accuracy, {f1('mr1', 'mr0')} AS mitigated_f1,
             tr1 + tr0 AS n_clean, mr1 + mr0 AS n_mitigated,
             coalesce(tp / nullif(tp + fp, 0), 0) AS det_precision,
             coalesce(tp / nullif(tp + fn, 0), 0) AS det_recall,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS det_f1,
             CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn
      FROM ({agg})"""


_RUNS = " UNION ALL ".join(_seed_sql(s) for s in SEEDS)


def _round(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


_STATS = """
    SELECT count(*) AS n_seeds,
           avg(clean_accuracy) AS clean_accuracy_mean, avg(poisoned_accuracy) AS poisoned_accuracy_mean,
           avg(clean_f1) AS clean_f1_mean, avg(poisoned_f1) AS poisoned_f1_mean,
           avg(clean_accuracy - poisoned_accuracy) AS accuracy_drop_mean,
           avg(clean_f1 - poisoned_f1) AS f1_drop_mean,
           coalesce(stddev_samp(clean_accuracy), 0) AS clean_accuracy_std,
           coalesce(stddev_samp(poisoned_accuracy), 0) AS poisoned_accuracy_std,
           coalesce(stddev_samp(clean_f1), 0) AS clean_f1_std,
           coalesce(stddev_samp(poisoned_f1), 0) AS poisoned_f1_std,
           coalesce(stddev_samp(n_flagged), 0) AS flagged_std,
           coalesce(stddev_samp(clean_accuracy - poisoned_accuracy), 0) AS accuracy_drop_std,
           coalesce(stddev_samp(clean_f1 - poisoned_f1), 0) AS f1_drop_std
    FROM ({runs})"""

_STAT_COLS = ("clean_accuracy_mean poisoned_accuracy_mean clean_f1_mean poisoned_f1_mean accuracy_drop_mean "
              "f1_drop_mean clean_accuracy_std poisoned_accuracy_std clean_f1_std poisoned_f1_std flagged_std "
              "accuracy_drop_std f1_drop_std")
_S1 = _seed_sql(1)

ORACLE = {
    "impact_recovery": f"""
        SELECT {_round('clean_accuracy poisoned_accuracy mitigated_accuracy clean_f1 poisoned_f1 mitigated_f1')},
               round(clean_accuracy - poisoned_accuracy, 6) AS accuracy_drop, round(clean_f1 - poisoned_f1, 6) AS f1_drop,
               round(mitigated_accuracy - poisoned_accuracy, 6) AS accuracy_recovery,
               round(mitigated_f1 - poisoned_f1, 6) AS f1_recovery,
               n_clean AS clean_samples, n_clean AS poisoned_samples, n_mitigated AS mitigated_samples
        FROM ({_S1})""",
    "config_table": f"""
        WITH c AS (SELECT n_clean AS n, tp + fn AS poisoned, n_flagged,
                          (SELECT count(*) FROM ({CORPUS_SQL}) WHERE {hash60_sql('1', 'row_id')} < {_CUT}) AS n_test
                   FROM ({_S1}))
        SELECT 'Dataset' AS parameter, 'documents+labels' AS value FROM c
        UNION ALL SELECT 'Model', 'majority class' FROM c
        UNION ALL SELECT 'Training samples', format('{{:,}}', n) FROM c
        UNION ALL SELECT 'Test samples', format('{{:,}}', n_test) FROM c
        UNION ALL SELECT 'Poison rate', printf('%.1f%%', 100 * poisoned / n) FROM c
        UNION ALL SELECT 'Poison strategy', 'label flip' FROM c
        UNION ALL SELECT unnest(['Max sequence length', 'Epochs', 'Learning rate', 'Batch size']), '—' FROM c
        UNION ALL SELECT 'Seeds', '1, 2, 3' FROM c
        UNION ALL SELECT 'Detector', 'seeded draw' FROM c
        UNION ALL SELECT 'Detector contamination', printf('%.1f%%', 100 * n_flagged / n) FROM c""",
    "summary_merged": f"""
        SELECT round(tp + fp + fn + tn, 6) AS rows_seen,
               {_round('clean_accuracy poisoned_accuracy clean_f1 poisoned_f1')},
               round(clean_accuracy - poisoned_accuracy, 6) AS accuracy_drop, round(clean_f1 - poisoned_f1, 6) AS f1_drop,
               round(det_precision, 6) AS detection_precision, round(det_recall, 6) AS detection_recall,
               round(det_f1, 6) AS detection_f1, round(n_flagged, 6) AS avg_n_flagged,
               round(coalesce(n_flagged / nullif(floor(tp + fp + fn + tn), 0), 0), 6) AS avg_flag_rate,
               round(tp, 6) AS true_positive, round(fp, 6) AS false_positive,
               round(fn, 6) AS false_negative, round(tn, 6) AS true_negative
        FROM ({_S1})""",
    "run_export": f"""
        SELECT seed, {_round('clean_accuracy poisoned_accuracy clean_f1 poisoned_f1 n_flagged')},
               round(tp, 6) AS true_positive, round(fp, 6) AS false_positive,
               round(fn, 6) AS false_negative, round(tn, 6) AS true_negative FROM ({_RUNS})""",
    "seed_runs": f"SELECT seed, {_round('clean_accuracy clean_f1 poisoned_accuracy poisoned_f1 n_flagged det_precision det_recall det_f1 tp fp fn tn')} FROM ({_RUNS})",
    "run_table": f"""SELECT seed, round(clean_accuracy, 6) AS clean_accuracy, round(poisoned_accuracy, 6) AS poisoned_accuracy,
                            round(clean_accuracy - poisoned_accuracy, 6) AS accuracy_drop,
                            round(clean_f1, 6) AS clean_f1, round(poisoned_f1, 6) AS poisoned_f1,
                            round(clean_f1 - poisoned_f1, 6) AS f1_drop, round(n_flagged, 6) AS flagged FROM ({_RUNS})""",
    "impact_table": f"""SELECT seed, round(clean_accuracy, 6) AS clean_accuracy, round(poisoned_accuracy, 6) AS poisoned_accuracy,
                               round(poisoned_accuracy - clean_accuracy, 6) AS accuracy_delta,
                               round(clean_f1, 6) AS clean_f1, round(poisoned_f1, 6) AS poisoned_f1,
                               round(poisoned_f1 - clean_f1, 6) AS f1_delta FROM ({_RUNS})""",
    "detection_audit": f"SELECT seed, round(n_flagged, 6) AS flagged, {_round('tp fp fn tn')} FROM ({_RUNS})",
    "run_matrix": f"SELECT seed, {_round('clean_accuracy poisoned_accuracy clean_f1 poisoned_f1 n_flagged tp fp fn tn')} FROM ({_RUNS})",
    "run_stats": f"""SELECT n_seeds, {_round(_STAT_COLS)},
                            n_seeds > 1 AND abs(accuracy_drop_std) > abs(coalesce(accuracy_drop_mean, 0)) * 0.5 AS variance_caution
                     FROM ({_STATS.format(runs=_RUNS)})""",
    "metric_resolution": f"""
        SELECT {_round('clean_accuracy poisoned_accuracy clean_f1 poisoned_f1')},
               round(clean_accuracy - poisoned_accuracy, 6) AS accuracy_drop, round(clean_f1 - poisoned_f1, 6) AS f1_drop,
               round(det_precision, 6) AS detection_precision, round(det_recall, 6) AS detection_recall,
               round(det_f1, 6) AS detection_f1, round(n_flagged, 6) AS avg_n_flagged,
               round(coalesce(n_flagged / nullif(floor(tp + fp + fn + tn), 0), 0), 6) AS avg_flag_rate,
               round(tp, 6) AS true_positive, round(fp, 6) AS false_positive,
               round(fn, 6) AS false_negative, round(tn, 6) AS true_negative,
               CAST(floor(tp + fp + fn + tn) AS BIGINT) AS train_samples, CAST(0 AS BIGINT) AS test_samples,
               round(coalesce((tp + fn) / nullif(floor(tp + fp + fn + tn), 0), 0), 6) AS poison_rate,
               CAST(round(tp + fn) AS BIGINT) AS poisoned_samples
        FROM ({_S1})""",
    "runs_synthesised": f"""
        SELECT 1 AS seed, {_round('clean_accuracy clean_f1 poisoned_accuracy poisoned_f1 n_flagged det_precision det_recall det_f1 tp fp fn tn')}
        FROM ({_S1})""",
}
# impact_mean_std: long form over the one-row statistics
ORACLE["impact_mean_std"] = f"""
    WITH s AS ({_STATS.format(runs=_RUNS)})
    SELECT 'clean' AS condition, 'accuracy' AS metric, round(clean_accuracy_mean, 6) AS mean, round(clean_accuracy_std, 6) AS std FROM s
    UNION ALL SELECT 'clean', 'f1', round(clean_f1_mean, 6), round(clean_f1_std, 6) FROM s
    UNION ALL SELECT 'poisoned', 'accuracy', round(poisoned_accuracy_mean, 6), round(poisoned_accuracy_std, 6) FROM s
    UNION ALL SELECT 'poisoned', 'f1', round(poisoned_f1_mean, 6), round(poisoned_f1_std, 6) FROM s"""
