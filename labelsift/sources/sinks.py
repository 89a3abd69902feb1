"""Sinks K1-K7. Everything is written by executors; nothing is collected."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.operators.runs import run_export


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1 (and K2/K7 for their tables): CSV with a header and ``"``-escaping
    (round-trips quotes and newlines with ``read_corpus``), or Parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("quote", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_framed(lines: DataFrame, path: str, first: str = "", between: str = "", last: str = "") -> None:
    """Text files of ``lines(value)``, one a task, each with a line before, a
    line behind and a prefix for every line but the first (none where empty)."""
    def frame(batches):
        if first:
            yield pa.RecordBatch.from_pydict({"value": [first]})
        started = False
        for b in batches:
            value = b.column("value")
            if between and len(value):
                lead = pa.array([between if started or i else "" for i in range(len(value))])
                value = pc.binary_join_element_wise(lead, value, "")
            started = started or len(value) > 0
            yield pa.RecordBatch.from_arrays([value], ["value"])
        if last:
            yield pa.RecordBatch.from_pydict({"value": [last]})
    lines.select("value").mapInArrow(frame, "value string").write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """K6 for tables: every file an array of records."""
    write_framed(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")),
                 path, "[", ",", "]")


def write_results(doc: DataFrame, path: str) -> None:
    """K3: the results document as JSON (overwrite)."""
    doc.coalesce(1).write.mode("overwrite").json(path)


def results_json(doc: DataFrame) -> DataFrame:
    """K6: the whole document as one JSON string column."""
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("json"))


def _leaves(schema: T.StructType, prefix: tuple = ()) -> list[tuple[tuple, T.DataType]]:
    out = []
    for f in schema.fields:
        path = (*prefix, f.name)
        out += _leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def metrics_long(record: DataFrame, run_id: str, section: str) -> DataFrame:
    """K4 input: a one-row record, nested or flat, as ``(run_id, section,
    metric, value, text)``: dotted names for nested fields, numbers in
    ``value``, everything else (strings, booleans, arrays as JSON) in
    ``text``. Nothing is dropped."""
    rows = []
    for path, t in _leaves(record.schema):
        c = F.col(f"`{path[0]}`")
        for p in path[1:]:
            c = c.getField(p)
        number = isinstance(t, T.NumericType)
        text = F.to_json(c) if isinstance(t, (T.ArrayType, T.MapType)) else c.cast("string")
        rows.append(F.struct(F.lit(".".join(path)).alias("metric"),
                             (c.cast("double") if number else F.lit(None).cast("double")).alias("value"),
                             (F.lit(None).cast("string") if number else text).alias("text")))
    long = record.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.select(F.lit(run_id).alias("run_id"), F.lit(section).alias("section"), "metric", "value", "text",
                       F.current_timestamp().alias("written_at"))


def _order_folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_order")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def commit_write(spark: SparkSession, path: str, write_id: str) -> int:
    """Take the next free number of the folder's order for a finished write. The
    number is a file created only if it does not exist, so two writers never
    share one, whatever their clocks say; returns the number. Hadoop's local file
    system looks for a file and then creates it, which two writers can do at once:
    there Java's atomic call takes the number."""
    fs, folder = _order_folder(spark, path)
    fs.mkdirs(folder)
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path
    at = fs.resolvePath(folder).toUri()
    local = at.getScheme() == "file"
    taken = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
    seq = max(taken, default=-1) + 1
    while True:
        if local and not jvm.java.io.File(at.getPath(), f"{seq:012d}").createNewFile():
            seq += 1
            continue
        try:
            out = fs.create(name(folder, f"{seq:012d}"), local)
        except Py4JJavaError:
            if not fs.exists(name(folder, f"{seq:012d}")):
                raise
            seq += 1
            continue
        out.write(bytearray(write_id.encode()))
        out.close()
        return seq


def append_metrics(record: DataFrame, path: str, run_id: str, section: str) -> str:
    """The first half of ``write_metrics``: the rows, not yet visible."""
    write_id = uuid.uuid4().hex
    metrics_long(record, run_id, section).withColumn("write_id", F.lit(write_id)).write.mode("append").parquet(path)
    return write_id


def write_metrics(record: DataFrame, path: str, run_id: str, section: str) -> int:
    """K4: append a section's fields and commit them; the reference's
    read-merge-write of one JSON section becomes an append plus
    ``latest_metrics`` on read, so sections written in any order, by any number
    of writers, never erase each other. Returns the write's number."""
    return commit_write(record.sparkSession, path, append_metrics(record, path, run_id, section))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed writes with ``write_seq``, their place in the order."""
    order = spark.read.text(f"{path.rstrip('/')}/_order").select(
        F.col("value").alias("write_id"),
        F.regexp_extract("_metadata.file_name", "[0-9]+", 0).cast("bigint").alias("write_seq"))
    return spark.read.parquet(path).join(order, "write_id").drop("write_id")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Latest entry per (run_id, section, metric): the greatest number of a
    commit, one aggregation combined map-side."""
    return metrics.groupBy("run_id", "section", "metric").agg(
        F.max(F.struct("write_seq", "written_at", "value", "text")).alias("m")) \
        .select("run_id", "section", "metric", "m.value", "m.text", "m.written_at", "m.write_seq")


def export_runs(runs: DataFrame, path: str) -> None:
    """K5: per-run metrics as a flat CSV (seed + 9 metrics), absent values empty."""
    write_table(run_export(runs), path, "csv")


def export_flagged(flagged: DataFrame, path: str, fmt: str = "csv") -> None:
    """K7: every flagged record, written by the executors (the reference ships
    them through the browser); nested values are serialised with to_json.
    P15: typed columns need no JSON-safe value recode."""
    cols = [F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name)
            for f in flagged.schema.fields]
    write_table(flagged.select(*cols), path, fmt)
