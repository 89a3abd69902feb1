"""Artifact manifest -- status, size and modification time per expected
path, from file metadata only (the ``binaryFile`` source, content pruned)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.functions.columns import DASH, fmt_mb


def _found(spark: SparkSession, label: str, path: str) -> DataFrame:
    """One row of what lies under ``path``: a file, or a folder of files (sizes
    summed, latest change)."""
    row = [F.lit(label).alias("artifact"), F.lit(path).alias("path")]
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(*row, F.lit("MISSING").alias("status"), F.lit(0).cast("bigint").alias("size"),
                                     F.lit(None).cast("timestamp").alias("changed"))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("size"),
                     F.max("modificationTime").alias("changed")) \
        .select(*row, F.lit("READY").alias("status"), "size", "changed")


def artifact_manifest(spark: SparkSession, expected: dict[str, str]) -> DataFrame:
    """``expected`` maps an artifact label to a path. Output: ``artifact, path,
    status ('READY'/'MISSING'), size, size_shown, modified``."""
    rows = reduce(DataFrame.unionByName, [_found(spark, k, v) for k, v in expected.items()])
    return rows.select("artifact", "path", "status", "size", fmt_mb("size").alias("size_shown"),
                       F.coalesce(F.date_format("changed", "yyyy-MM-dd HH:mm"), F.lit(DASH)).alias("modified"))
