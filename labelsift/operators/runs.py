"""Run-level metrics (R1-R14, A14-A16) over results documents and per-seed
runs.

A results document is a one-row DataFrame (e.g. read by
``sources.results.read_results``); ``runs`` is a DataFrame with one row per
seed: ``seed, clean{accuracy,f1}, poisoned{accuracy,f1},
detection{n_flagged | flagged_samples, precision, recall, f1,
confusion_matrix{true_positive, false_positive, false_negative,
true_negative}}``. Fields may be absent from the schema; absent and null are
treated alike (display default 0, excluded from spreads).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.functions.columns import DASH, fmt_num, fmt_pct, num

RUN_SCHEMA = (
    "seed int, clean struct<accuracy double, f1 double>, "
    "poisoned struct<accuracy double, f1 double>, "
    "detection struct<n_flagged bigint, precision double, recall double, f1 double, "
    "confusion_matrix struct<true_positive bigint, false_positive bigint, "
    "false_negative bigint, true_negative bigint>>")

# The metrics of the normalised summary, in the reference's order.
SUMMARY_METRICS = (
    "clean_accuracy", "poisoned_accuracy", "clean_f1", "poisoned_f1", "accuracy_drop",
    "f1_drop", "detection_precision", "detection_recall", "detection_f1", "avg_n_flagged",
    "avg_flag_rate", "true_positive", "false_positive", "false_negative", "true_negative",
)


def field(df: DataFrame, path: str, prefix: Column | None = None) -> Column:
    """Nested field by dotted path, or a typed null when the schema lacks it."""
    dt: T.DataType = df.schema
    parts = path.split(".")
    for p in parts:
        if isinstance(dt, T.StructType) and p in dt.fieldNames():
            dt = dt[p].dataType
        else:
            return F.lit(None).cast("double")
    c = prefix
    for p in parts:
        c = F.col(p) if c is None else c.getField(p)
    return c


def _d(c: Column) -> Column:
    return c.try_cast("double")


def run_rows(runs: DataFrame) -> DataFrame:
    """Flat per-seed rows; R5: ``n_flagged`` falls back to ``flagged_samples``;
    R4: confusion cells fall back from flat to nested fields."""
    det = "detection"
    flagged = F.coalesce(_d(field(runs, f"{det}.n_flagged")), _d(field(runs, f"{det}.flagged_samples")))

    def cell(name):
        return F.coalesce(_d(field(runs, f"{det}.{name}")),
                          _d(field(runs, f"{det}.confusion_matrix.{name}")))

    return runs.select(
        field(runs, "seed").alias("seed"),
        _d(field(runs, "clean.accuracy")).alias("clean_accuracy"),
        _d(field(runs, "clean.f1")).alias("clean_f1"),
        _d(field(runs, "poisoned.accuracy")).alias("poisoned_accuracy"),
        _d(field(runs, "poisoned.f1")).alias("poisoned_f1"),
        flagged.alias("n_flagged"),
        _d(field(runs, f"{det}.precision")).alias("det_precision"),
        _d(field(runs, f"{det}.recall")).alias("det_recall"),
        _d(field(runs, f"{det}.f1")).alias("det_f1"),
        cell("true_positive").alias("tp"), cell("false_positive").alias("fp"),
        cell("false_negative").alias("fn"), cell("true_negative").alias("tn"))


def _z(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def run_table(runs: DataFrame) -> DataFrame:
    """Seed, metrics, ``drop = clean - poisoned``, flagged."""
    r = run_rows(runs)
    return r.select("seed", _z("clean_accuracy").alias("clean_accuracy"),
                    _z("poisoned_accuracy").alias("poisoned_accuracy"),
                    (_z("clean_accuracy") - _z("poisoned_accuracy")).alias("accuracy_drop"),
                    _z("clean_f1").alias("clean_f1"), _z("poisoned_f1").alias("poisoned_f1"),
                    (_z("clean_f1") - _z("poisoned_f1")).alias("f1_drop"),
                    _z("n_flagged").alias("flagged"))


def impact_table(runs: DataFrame) -> DataFrame:
    """Signed change ``poisoned - clean`` (opposite sign of R7's drop)."""
    r = run_rows(runs)
    return r.select("seed", _z("clean_accuracy").alias("clean_accuracy"),
                    _z("poisoned_accuracy").alias("poisoned_accuracy"),
                    (_z("poisoned_accuracy") - _z("clean_accuracy")).alias("accuracy_delta"),
                    _z("clean_f1").alias("clean_f1"), _z("poisoned_f1").alias("poisoned_f1"),
                    (_z("poisoned_f1") - _z("clean_f1")).alias("f1_delta"))


def detection_audit(runs: DataFrame) -> DataFrame:
    """Per-seed flagged and confusion cells."""
    r = run_rows(runs)
    return r.select("seed", *[_z(c).alias(a) for c, a in
                              (("n_flagged", "flagged"), ("tp", "tp"), ("fp", "fp"),
                               ("fn", "fn"), ("tn", "tn"))])


def run_matrix(runs: DataFrame) -> DataFrame:
    """The raw per-seed matrix (4 model metrics, flagged, 4 cells)."""
    r = run_rows(runs)
    cols = ("clean_accuracy", "poisoned_accuracy", "clean_f1", "poisoned_f1",
            "n_flagged", "tp", "fp", "fn", "tn")
    return r.select("seed", *[_z(c).alias(c) for c in cols])


def _sd(c: Column) -> Column:
    """Sample std (ddof 1); 0 when fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def _paired(a: str, b: str) -> Column:
    # Per-seed difference, only for seeds having both values
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) - F.col(b))


def run_stats(runs: DataFrame) -> DataFrame:
    """A14-A16 + R11 in one aggregation: seed count, per-metric means and
    spreads, paired drop spreads and the variance caution flag."""
    r = run_rows(runs)
    s = r.agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("clean_accuracy").alias("clean_accuracy_mean"),
        F.avg("poisoned_accuracy").alias("poisoned_accuracy_mean"),
        F.avg("clean_f1").alias("clean_f1_mean"),
        F.avg("poisoned_f1").alias("poisoned_f1_mean"),
        F.avg(_paired("clean_accuracy", "poisoned_accuracy")).alias("accuracy_drop_mean"),
        F.avg(_paired("clean_f1", "poisoned_f1")).alias("f1_drop_mean"),
        _sd(F.col("clean_accuracy")).alias("clean_accuracy_std"),
        _sd(F.col("poisoned_accuracy")).alias("poisoned_accuracy_std"),
        _sd(F.col("clean_f1")).alias("clean_f1_std"),
        _sd(F.col("poisoned_f1")).alias("poisoned_f1_std"),
        _sd(F.col("n_flagged")).alias("flagged_std"),
        _sd(_paired("clean_accuracy", "poisoned_accuracy")).alias("accuracy_drop_std"),
        _sd(_paired("clean_f1", "poisoned_f1")).alias("f1_drop_std"))
    return s.withColumn("variance_caution", variance_caution(
        F.col("n_seeds"), F.col("accuracy_drop_std"), F.coalesce(F.col("accuracy_drop_mean"), F.lit(0.0))))


def variance_caution(n_seeds: Column, drop_std: Column, drop: Column) -> Column:
    """More than one seed and a spread above half the drop."""
    return (n_seeds > 1) & (F.abs(drop_std) > F.abs(drop) * 0.5)


def impact_mean_std(runs: DataFrame) -> DataFrame:
    """Long form ``(condition, metric, mean, std)`` for clean/poisoned x
    accuracy/F1 (unpivot of the one-row statistics)."""
    s = run_stats(runs)
    rows = []
    for cond in ("clean", "poisoned"):
        for m in ("accuracy", "f1"):
            rows.append(F.struct(F.lit(cond).alias("condition"), F.lit(m).alias("metric"),
                                 F.col(f"{cond}_{m}_mean").alias("mean"),
                                 F.col(f"{cond}_{m}_std").alias("std")))
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- documents


def _summary_value(doc: DataFrame, key: str) -> Column:
    """R1 summary entry: a number, or a struct with ``mean``."""
    dt = doc.schema
    if "summary" not in dt.fieldNames():
        return F.lit(None).cast("double")
    sdt = dt["summary"].dataType
    if not isinstance(sdt, T.StructType) or key not in sdt.fieldNames():
        return F.lit(None).cast("double")
    inner = sdt[key].dataType
    c = F.col("summary").getField(key)
    if isinstance(inner, T.StructType):
        return _d(c.getField("mean")) if "mean" in inner.fieldNames() else F.lit(None).cast("double")
    return _d(c)


def _resolve(doc: DataFrame, section_field: str, summary_key: str) -> Column:
    return F.coalesce(_d(field(doc, section_field)), _summary_value(doc, summary_key), F.lit(0.0))


def _normalised(doc: DataFrame) -> dict[str, Column]:
    """R1 + R3-R6 as named column expressions over the one-row document."""
    train = F.coalesce(_d(field(doc, "config.train_samples")), _d(field(doc, "detection.total_samples")), F.lit(0.0))
    test = F.coalesce(_d(field(doc, "config.test_samples")), F.lit(0.0))
    actual = F.coalesce(_d(field(doc, "detection.actual_poisoned")), F.lit(0.0))
    rate0 = F.coalesce(_d(field(doc, "config.poison_rate")), F.lit(0.0))
    flagged = F.coalesce(_d(field(doc, "detection.flagged_samples")), _d(field(doc, "detection.avg_n_flagged")),
                         _d(field(doc, "detection.n_flagged")), F.lit(0.0))
    frate0 = F.coalesce(_d(field(doc, "detection.flag_rate")), _d(field(doc, "detection.avg_flag_rate")), F.lit(0.0))
    t = F.floor(train)
    rate = F.when((rate0 == 0) & (t > 0), actual / t).otherwise(rate0)

    def cell(name):
        return F.coalesce(_d(field(doc, f"detection.{name}")),
                          _d(field(doc, f"detection.confusion_matrix.{name}")), F.lit(0.0))

    return {
        "clean_accuracy": _resolve(doc, "clean_model.accuracy", "clean_accuracy"),
        "poisoned_accuracy": _resolve(doc, "poisoned_model.accuracy", "poisoned_accuracy"),
        "clean_f1": _resolve(doc, "clean_model.f1", "clean_f1"),
        "poisoned_f1": _resolve(doc, "poisoned_model.f1", "poisoned_f1"),
        "accuracy_drop": _resolve(doc, "impact.accuracy_drop", "accuracy_drop"),
        "f1_drop": _resolve(doc, "impact.f1_drop", "f1_drop"),
        "detection_precision": _resolve(doc, "detection.precision", "detection_precision"),
        "detection_recall": _resolve(doc, "detection.recall", "detection_recall"),
        "detection_f1": _resolve(doc, "detection.f1", "detection_f1"),
        "avg_n_flagged": flagged,
        "avg_flag_rate": F.when((frate0 == 0) & (t > 0), flagged / t).otherwise(frate0),
        "true_positive": cell("true_positive"), "false_positive": cell("false_positive"),
        "false_negative": cell("false_negative"), "true_negative": cell("true_negative"),
        "train_samples": t.cast("bigint"), "test_samples": F.floor(test).cast("bigint"),
        "poison_rate": rate,
        "poisoned_samples": F.round(F.when(actual != 0, actual).otherwise(t * rate)).cast("bigint"),
    }


def normalise_results(doc: DataFrame) -> DataFrame:
    """R1 + R3-R6: the normalised summary (15 metrics) and dataset facts."""
    return doc.select(*[c.alias(k) for k, c in _normalised(doc).items()])


def runs_of(doc: DataFrame) -> DataFrame:
    """R2: the document's ``runs``, or one synthesised run from the top-level
    sections (seed = config.random_state, default 42) when ``runs`` is absent
    or empty and any of clean_model / poisoned_model / detection exists."""
    n = _normalised(doc)
    seed = F.coalesce(field(doc, "config.random_state").cast("int"), F.lit(42))
    synth_cols = [
        seed.alias("seed"),
        F.struct(n["clean_accuracy"].alias("accuracy"), n["clean_f1"].alias("f1")).alias("clean"),
        F.struct(n["poisoned_accuracy"].alias("accuracy"), n["poisoned_f1"].alias("f1")).alias("poisoned"),
        F.struct(n["avg_n_flagged"].cast("bigint").alias("n_flagged"),
                 n["detection_precision"].alias("precision"), n["detection_recall"].alias("recall"),
                 n["detection_f1"].alias("f1"),
                 F.struct(*[n[c].cast("bigint").alias(c) for c in
                            ("true_positive", "false_positive", "false_negative", "true_negative")])
                 .alias("confusion_matrix")).alias("detection"),
    ]
    present = F.lit(False)
    for sec in ("clean_model", "poisoned_model", "detection"):
        if sec in doc.columns:
            present = present | F.col(sec).isNotNull()
    if "runs" in doc.columns and isinstance(doc.schema["runs"].dataType, T.ArrayType):
        has_runs = F.coalesce(F.size("runs") > 0, F.lit(False))
        exploded = doc.where(has_runs).select(F.explode("runs").alias("r")).select("r.*")
    else:
        has_runs, exploded = F.lit(False), None
    synth = doc.where(present & ~has_runs).select(*synth_cols)
    if exploded is None:
        return synth
    return exploded.unionByName(synth, allowMissingColumns=True)


# The parameters of the configuration table, in display order
# (label, field of the config section, format).
CONFIG_PARAMETERS = (
    ("Dataset", "dataset_name", "text"),
    ("Model", "model_name", "text"),
    ("Training samples", "train_samples", "count"),
    ("Test samples", "test_samples", "count"),
    ("Poison rate", "poison_rate", "percent"),
    ("Poison strategy", "poison_strategy", "text"),
    ("Max sequence length", "max_seq_len", "text"),
    ("Epochs", "epochs", "text"),
    ("Learning rate", "learning_rate", "text"),
    ("Batch size", "batch_size", "text"),
    ("Seeds", "seeds", "list"),
    ("Detector", "detector", "text"),
    ("Detector contamination", "detector_contamination", "percent"),
)


def config_rows(doc: DataFrame) -> DataFrame:
    """The thirteen configuration parameters as ``(parameter, value)``
    rows: counts with thousands separators, rates in percent, lists joined by
    commas, a dash for absent text."""
    def shown(name: str, kind: str) -> Column:
        c = field(doc, f"config.{name}")
        if kind == "count":
            return fmt_num(F.floor(num(c)), 0)
        if kind == "percent":
            return fmt_pct(c, 1)
        if kind == "list":
            is_list = "config" in doc.columns and name in doc.schema["config"].dataType.fieldNames() and \
                isinstance(doc.schema["config"].dataType[name].dataType, T.ArrayType)
            return F.concat_ws(", ", c.cast("array<string>")) if is_list else F.coalesce(c.cast("string"), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(DASH))

    rows = [F.struct(F.lit(label).alias("parameter"), shown(name, kind).alias("value"))
            for label, name, kind in CONFIG_PARAMETERS]
    return doc.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def merged_summary(doc: DataFrame) -> DataFrame:
    """The raw ``summary`` section with the fifteen normalised metrics
    written over it; entries of other names stay as they are."""
    n = _normalised(doc)
    dt = doc.schema["summary"].dataType if "summary" in doc.columns else None
    raw = [f for f in dt.fieldNames() if f not in SUMMARY_METRICS] if isinstance(dt, T.StructType) else []
    return doc.select(*[F.col("summary").getField(f).alias(f) for f in raw],
                      *[n[m].alias(m) for m in SUMMARY_METRICS])


def run_export(runs: DataFrame) -> DataFrame:
    """K5 rows: the ten columns of the per-run export, from the run's own fields
    (no fallbacks); absent values stay null."""
    cells = ("true_positive", "false_positive", "false_negative", "true_negative")
    return runs.select(
        field(runs, "seed").alias("seed"),
        *[_d(field(runs, f"{c}.{m}")).alias(f"{c}_{m}") for m in ("accuracy", "f1") for c in ("clean", "poisoned")],
        _d(field(runs, "detection.n_flagged")).alias("n_flagged"),
        *[_d(field(runs, f"detection.confusion_matrix.{c}")).alias(c) for c in cells])
