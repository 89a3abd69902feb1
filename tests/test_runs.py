"""R1-R14, A14-A16 on the runs fixtures of FIXTURES.md."""

import json

import numpy as np

from labelsift.operators import runs as R
from labelsift.sources.results import read_results


def write_json(tmp_path, name, obj):
    p = tmp_path / name
    p.write_text(json.dumps(obj, indent=2))
    return str(p)


RUNS3 = [
    {"seed": 1, "clean": {"accuracy": 0.90, "f1": 0.91}, "poisoned": {"accuracy": 0.85, "f1": 0.86},
     "detection": {"n_flagged": 10, "confusion_matrix": {"true_positive": 3, "false_positive": 7,
                                                         "false_negative": 2, "true_negative": 88}}},
    {"seed": 2, "clean": {"accuracy": 0.92}, "poisoned": {"accuracy": 0.80, "f1": 0.81},
     "detection": {"flagged_samples": 12}},
    {"seed": 3, "clean": {"accuracy": 0.88, "f1": 0.89}, "poisoned": {"accuracy": 0.86, "f1": 0.87},
     "detection": {"n_flagged": 8}},
]


def test_runs3_spreads_and_aliases(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "r.json", {"runs": RUNS3}))
    runs = R.runs_of(doc)
    rows = {r["seed"]: r for r in R.run_rows(runs).collect()}
    assert rows[2]["n_flagged"] == 12 and rows[2]["clean_f1"] is None
    s = R.run_stats(runs).first()
    assert s["n_seeds"] == 3
    assert abs(s["clean_accuracy_std"] - np.std([0.90, 0.92, 0.88], ddof=1)) < 1e-12
    assert abs(s["clean_f1_std"] - np.std([0.91, 0.89], ddof=1)) < 1e-12
    assert abs(s["flagged_std"] - np.std([10, 12, 8], ddof=1)) < 1e-12
    assert abs(s["f1_drop_std"] - np.std([0.91 - 0.86, 0.89 - 0.87], ddof=1)) < 1e-12
    drop = np.mean([0.05, 0.12, 0.02])
    assert s["variance_caution"] == (np.std([0.05, 0.12, 0.02], ddof=1) > 0.5 * drop)
    t = {r["seed"]: r for r in R.run_table(runs).collect()}
    assert abs(t[1]["accuracy_drop"] - 0.05) < 1e-12 and t[2]["clean_f1"] == 0.0
    i = {r["seed"]: r for r in R.impact_table(runs).collect()}
    assert abs(i[1]["accuracy_delta"] + 0.05) < 1e-12
    a = {r["seed"]: r for r in R.detection_audit(runs).collect()}
    assert (a[1]["tp"], a[1]["fp"], a[3]["tp"]) == (3.0, 7.0, 0.0)
    long = {(r["condition"], r["metric"]): r for r in R.impact_mean_std(runs).collect()}
    assert len(long) == 4 and abs(long[("clean", "accuracy")]["mean"] - 0.90) < 1e-12


def test_runs1_no_caution(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "r.json", {"runs": RUNS3[:1]}))
    s = R.run_stats(R.runs_of(doc)).first()
    assert s["clean_accuracy_std"] == 0.0 and s["variance_caution"] is False


def test_results_without_runs_synthesise_one(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "one.json", {
        "config": {"train_samples": 4000, "test_samples": 1000, "poisoned_samples": 200, "random_state": 7},
        "clean_model": {"accuracy": 0.81, "f1": 0.8}, "poisoned_model": {"accuracy": 0.78, "f1": 0.77},
        "impact": {"accuracy_drop": 0.03, "f1_drop": 0.03},
        "detection": {"total_samples": 4000, "actual_poisoned": 200, "flagged_samples": 190, "flag_rate": 0.0475,
                      "precision": 0.1, "recall": 0.095, "f1": 0.0974,
                      "confusion_matrix": {"true_positive": 19, "false_positive": 171,
                                           "false_negative": 181, "true_negative": 3629}}}))
    runs = R.run_rows(R.runs_of(doc)).collect()
    assert len(runs) == 1
    r = runs[0]
    assert r["seed"] == 7 and r["clean_accuracy"] == 0.81 and r["n_flagged"] == 190
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (19, 171, 181, 3629)
    n = R.normalise_results(doc).first()
    assert n["train_samples"] == 4000 and n["poisoned_samples"] == 200 and n["poison_rate"] == 0.05
    assert abs(n["accuracy_drop"] - 0.03) < 1e-12
    assert r["tp"] + r["fp"] == n["avg_n_flagged"] and r["tp"] + r["fn"] == n["poisoned_samples"]


def test_summary_forms(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "s.json", {
        "summary": {"clean_accuracy": {"mean": 0.7, "std": 0.1}, "poisoned_accuracy": 0.6},
        "detection": {"confusion_matrix": {"true_positive": 4}, "total_samples": 100,
                      "actual_poisoned": 5, "avg_n_flagged": 10}}))
    n = R.normalise_results(doc).first()
    assert (n["clean_accuracy"], n["poisoned_accuracy"], n["clean_f1"]) == (0.7, 0.6, 0.0)
    assert (n["true_positive"], n["avg_n_flagged"], n["avg_flag_rate"]) == (4.0, 10.0, 0.1)
    assert (n["train_samples"], n["poison_rate"], n["poisoned_samples"]) == (100, 0.05, 5)


def test_missing_or_invalid_results(spark, tmp_path):
    assert read_results(spark, str(tmp_path / "nope.json")) is None
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert read_results(spark, str(bad)) is None


def test_config_rows(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "c.json", {"config": {"dataset_name": "X", "seeds": [1, 2]}}))
    rows = {r["parameter"]: r["value"] for r in R.config_rows(doc).collect()}
    assert rows["Dataset"] == "X" and rows["Seeds"] == "1, 2" and rows["Detector"] == "—"


def test_recovery_record_and_sinks(spark, tmp_path):
    from labelsift.plans.experiment import recovery, recovery_record
    from labelsift.sources.sinks import export_flagged, export_runs, results_json, write_results
    cond = spark.createDataFrame([("clean", 100, 50, 0.9, 0.91), ("poisoned", 100, 50, 0.8, 0.82),
                                  ("mitigated", 95, 50, 0.88, 0.9)],
                                 "condition string, n_train long, n_test long, accuracy double, f1 double")
    r = recovery(cond).first()
    assert abs(r["accuracy_drop"] - 0.1) < 1e-12 and abs(r["accuracy_recovery"] - 0.08) < 1e-12
    doc = recovery_record(cond)
    d = doc.first()
    assert d["experiment"] == "mitigation" and d["dataset"]["test_samples"] == 50
    assert d["dataset"]["mitigated_samples"] == 95 and abs(d["impact"]["f1_recovery"] - 0.08) < 1e-12
    out = str(tmp_path / "doc")
    write_results(doc, out)
    back = read_results(spark, out)
    assert back.first()["impact"]["accuracy_drop"] == d["impact"]["accuracy_drop"]
    js = json.loads(results_json(doc).first()["json"])
    assert js["clean"]["accuracy"] == 0.9
    runs = R.runs_of(read_results(spark, write_json(tmp_path, "r.json", {"runs": RUNS3})))
    export_runs(runs, str(tmp_path / "runs_csv"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "runs_csv"))
    assert csv.count() == 3 and len(csv.columns) == 10
    flagged = spark.createDataFrame([(1, "x", {"a": 1})], "k long, text string, m map<string,int>")
    export_flagged(flagged, str(tmp_path / "flagged"))
    back = spark.read.option("header", True).option("escape", "\"").csv(str(tmp_path / "flagged"))
    assert back.first()["m"] == '{"a":1}'


def test_run_export_keeps_nulls_and_ten_columns(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "x.json", {"runs": RUNS3}))
    rows = {r["seed"]: r for r in R.run_export(R.runs_of(doc)).collect()}
    assert R.run_export(R.runs_of(doc)).columns == [
        "seed", "clean_accuracy", "poisoned_accuracy", "clean_f1", "poisoned_f1", "n_flagged",
        "true_positive", "false_positive", "false_negative", "true_negative"]
    assert rows[2]["clean_f1"] is None and rows[2]["n_flagged"] is None and rows[2]["true_positive"] is None
    assert rows[1]["true_negative"] == 88 and rows[3]["n_flagged"] == 8


def test_merged_summary_keeps_unknown_entries(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "m.json", {
        "summary": {"note": "kept", "clean_accuracy": 0.1, "extra": {"mean": 3, "std": 1}},
        "clean_model": {"accuracy": 0.9, "f1": 0.8}}))
    m = R.merged_summary(doc).first()
    assert m["note"] == "kept" and m["extra"]["mean"] == 3 and m["clean_accuracy"] == 0.9
    assert set(R.SUMMARY_METRICS) <= set(R.merged_summary(doc).columns)


def test_config_table_defaults_and_formats(spark, tmp_path):
    doc = read_results(spark, write_json(tmp_path, "c.json", {
        "config": {"train_samples": 25000.7, "poison_rate": 0.05, "seeds": [1, 2], "epochs": 3,
                   "detector_contamination": 12.5}}))
    got = {r["parameter"]: r["value"] for r in R.config_rows(doc).collect()}
    assert len(got) == 13
    assert got["Training samples"] == "25,000" and got["Test samples"] == "0"
    assert got["Poison rate"] == "5.0%" and got["Detector contamination"] == "12.5%"
    assert got["Seeds"] == "1, 2" and got["Epochs"] == "3" and got["Model"] == "—"
    none = {r["parameter"]: r["value"] for r in R.config_rows(spark.sql("SELECT 1 AS x")).collect()}
    assert len(none) == 13 and none["Seeds"] == "" and none["Poison rate"] == "0.0%"


def test_number_formats(spark):
    from labelsift.functions.columns import fmt_mb, fmt_num, fmt_pct
    r = spark.sql("SELECT 1234567.891D AS x, 0.0576D AS p, 5767168L AS b, 'n/a' AS bad, CAST(NULL AS BIGINT) AS z").select(
        fmt_num("x"), fmt_num("x", 0), fmt_pct("p"), fmt_pct("x", 2), fmt_mb("b"), fmt_num("bad"), fmt_mb("z")).first()
    assert tuple(r) == ("1,234,567.89", "1,234,568", "5.8%", "1234567.89%", "5.50 MB", "0.00", "—")
