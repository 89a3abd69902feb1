"""A9-A13, P12, M3-M5, R12."""

import numpy as np

from labelsift.operators import metrics as M


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "is_poisoned int, detector_flag int")


def test_confusion_fixed_labels_and_zero_division(spark):
    s = M.score_flags(frame(spark, [(0, 0), (0, 0), (0, 0)])).first()
    assert (s["tn"], s["fp"], s["fn"], s["tp"]) == (3, 0, 0, 0)
    assert (s["precision"], s["recall"], s["f1"]) == (0.0, 0.0, 0.0)
    g = M.gated_scores(frame(spark, [(0, 1), (0, 0)]), "is_poisoned", "detector_flag").first()
    assert g["both_classes"] is False and g["f1"] is None


def test_prf_values(spark):
    s = M.score_flags(frame(spark, [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)])).first()
    assert (s["tp"], s["fp"], s["fn"], s["tn"]) == (2, 1, 1, 1)
    assert abs(s["precision"] - 2 / 3) < 1e-12 and abs(s["recall"] - 2 / 3) < 1e-12
    assert abs(s["f1"] - 2 / 3) < 1e-12 and s["flag_rate"] == 0.6


def test_confusion_pivot(spark):
    rows = {r["actual"]: (r["pred_0"], r["pred_1"])
            for r in M.confusion_pivot(frame(spark, [(1, 1), (0, 0), (0, 0)])).collect()}
    assert rows == {0: (2, 0), 1: (0, 1)}


def test_truth_strings(spark):
    vals = ["1", " TRUE ", "Yes", "y", "Poisoned", "poison", "0", "no", "1.0", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, is_poisoned string")
    out, src = M.ground_truth(df)
    assert src == "is_poisoned column"
    assert [r["truth"] for r in out.orderBy("i").collect()] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_truth_labels(spark):
    pairs = [("0", "0"), ("0", "1"), ("spam", " spam "), (None, None), (None, "0")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "i int, original_label string, label string")
    out, src = M.ground_truth(df)
    assert src == "original_label vs label"
    assert [r["truth"] for r in out.orderBy("i").collect()] == [0, 1, 0, 0, 1]
    assert M.ground_truth(df.drop("original_label"))[1] is None


def test_contamination_rules(spark):
    r = spark.range(1).select(M.contamination_supervised(0.6).alias("a"),
                              M.contamination_supervised(0.0).alias("b"),
                              M.contamination_unsupervised(10).alias("c"),
                              M.contamination_unsupervised(5000).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (0.49, 0.001, 0.05, 0.001)


def test_flag_by_contamination_matches_numpy(spark):
    rng = np.random.default_rng(3)
    s = rng.random(400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "k int, score double")
    out = M.flag_by_contamination(df, "score", 0.05).orderBy("k").collect()
    off = np.percentile(-s, 5)
    assert [r["flag"] for r in out] == list(((-s) < off).astype(int))
    assert sum(r["flag"] for r in out) == 20


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.0,)], "x double")
    h = {r["bin"]: r["n"] for r in M.histogram(df, "x", 30).collect()}
    assert h == {0: 1, 15: 1, 29: 2}
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in M.histogram(same, "x").collect()] == [(0, 2)]
