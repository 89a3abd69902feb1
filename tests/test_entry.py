"""Driver contract: every query has a callable, oracle keys are a subset,
and the flagship runs on the smoke data."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as E

from tests.conftest import SF001


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["flagged_samples"] == r["actual_poisoned"] == 4
    assert r["true_positive"] + r["false_positive"] + r["false_negative"] + r["true_negative"] == r["total_samples"]


def test_small_query_on_smoke_data(spark):
    q = E.queries()
    assert q["poison_index"](spark, SF001).count() == 4
    assert q["confusion_matrix"](spark, SF001).count() == 1


def test_import_without_the_optional_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(E.__file__))
    for pipeline_stays in (True, False):
        copy = tmp_path / str(pipeline_stays)
        copy.mkdir()
        shutil.copytree(f"{root}/labelsift", copy / "labelsift",
                        ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for f in ["__spark_entry__.py", "bench.py"] + ["corpus_pipeline.py"] * pipeline_stays:
            if os.path.exists(f"{root}/{f}"):
                shutil.copy(f"{root}/{f}", copy / f)
        code = ("import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); "
                "assert len(q) >= 50 and set(o) <= set(q); "
                "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)")
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120,
                       env={**os.environ, "PYTHONPATH": str(copy)})
