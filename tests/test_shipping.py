"""Python workers import labelsift from the shipped zip (addPyFile), not from
the driver's working directory: run a pandas UDF that imports the package in
a process started outside the repository."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_import_shipped_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        from labelsift.session import ship_package

        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        ship_package(spark)

        def run(batches):
            from labelsift.operators.iforest import c_factor
            for pdf in batches:
                pdf["c"] = c_factor(pdf["id"].to_numpy() + 2)
                yield pdf

        out = spark.range(3).mapInPandas(run, "id long, c double").collect()
        print("OK", [round(r["c"], 6) for r in out])
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=300)
    assert "OK [1.0," in res.stdout, res.stderr[-2000:]
