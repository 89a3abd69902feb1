"""Results documents (JSON). A missing or unreadable document reads as
"no results" (``None``), as in the reference's loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def read_results(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """One document per file (pretty-printed JSON); ``None`` when the path is
    missing or the content is not valid JSON."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    try:
        df = r.json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if df.columns == ["_corrupt_record"] or not df.columns:
        return None
    if "_corrupt_record" in df.columns:
        df = df.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return df
