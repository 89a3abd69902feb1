"""Corpus sources: S1 header CSV, S2 missing-input guard, S3 two-split corpus,
P1 projection, P2 required columns, and the driver-table corpus view."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.functions.columns import hash60
from labelsift.sources.delimited import corpus_table

CORPUS_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def driver_corpus(spark: SparkSession, sf_dir: str, label_col: str = "quality") -> DataFrame:
    """Corpus view over the driver data: ``documents JOIN labels USING (doc_id)``
    projected to ``(row_id, text, label)``; P5: the label is cast to INT. Both sides grow with the data, so
    the join is left to the planner (sort-merge, or broadcast when AQE sees a
    small side at runtime)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label_col).cast("int").alias("label"))
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "label")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Schema-only check (no job); the error lists every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}; it has {df.columns}")
    return df


MAX_SPLITS_BROADCAST = 1_000_000  # one small row per input split


def with_file_order_key(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Give a key-less file source a BIGINT key in file order (0-based): rows
    per input split (file, block start) are counted, and a row's key is the sum
    over the splits before its own plus its index inside the split. No sort, no
    copy of the rows; one row per split reaches the driver. A frame that is no
    plain scan of files falls back to its partition order."""
    from labelsift.operators.ordinal import ordinal

    if key in df.columns:
        raise ValueError(f"column {key!r} already exists")
    try:
        tagged = df.select("*", F.col("_metadata.file_path").alias("_f"),
                           F.col("_metadata.file_block_start").alias("_b"),
                           F.monotonically_increasing_id().alias("_m"))
        tagged.schema  # noqa: B018 -- analysis: other frames have no file metadata
    except AnalysisException:
        tagged = df.withColumn("_pos", F.monotonically_increasing_id())
        return ordinal(tagged, ["_pos"], key).drop("_pos")
    splits = sorted((r["_f"], r["_b"], r["n"], r["lo"]) for r in tagged.groupBy("_f", "_b")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("lo")).collect())
    base, run = [], 0
    for f, b, n, lo in splits:
        base.append((f, b, run - lo))
        run += n
    table_ = df.sparkSession.createDataFrame(base, "_f string, _b bigint, _off bigint")
    if len(base) <= MAX_SPLITS_BROADCAST:
        table_ = F.broadcast(table_)
    return tagged.join(table_, ["_f", "_b"]).select(
        (F.col("_off") + F.col("_m")).alias(key), *[F.col(f"`{c}`") for c in df.columns])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None,
                required: Iterable[str] = (), fmt: str = "csv", key: str = "row_id",
                null_values: Iterable[str] = (), multi_line: bool = True) -> DataFrame:
    """S1 + S2 + P2: read a corpus file. CSV has a header and doubled quotes;
    quoted fields may hold line breaks wherever an input split ends (``records``).
    ``multi_line=False`` leaves the file to Spark's line-by-line reader, for fields
    without line breaks.

    A missing path surfaces as Spark's PATH_NOT_FOUND error naming the path.
    Without a key column one is attached in file order.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        if multi_line:
            df = corpus_table(spark, path, schema, key)
        else:
            r = spark.read.option("header", True).option("escape", '"').option("quote", '"')
            r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
            df = r.csv(path)
        for nv in null_values:
            df = df.select(*[F.when(F.col(c) == F.lit(nv), F.lit(None)).otherwise(F.col(c)).alias(c)
                             if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
                             for c in df.columns])
    else:
        df = spark.read.format(fmt).load(path)
    require_columns(df, required)
    if key not in df.columns:
        df = with_file_order_key(df, key)
    return df


def project_corpus(df: DataFrame, key: str = "row_id", text: str = "text",
                   label: str = "label") -> DataFrame:
    """Keep only the key, text and label (pruned at the scan by Catalyst)."""
    return df.select(key, text, label)


def train_test_split(df: DataFrame, key: str = "row_id", test_rate: float = 0.5,
                     seed: int = 42) -> DataFrame:
    """S3: add ``split`` ('train'/'test') from a seeded 60-bit hash of the key.

    Row-local (no shuffle, no sort); independent of partitioning. A row is
    'test' iff ``hash60(seed, key) < floor(test_rate * 2**60)``.
    """
    cut = int(test_rate * (1 << 60))
    return df.withColumn("split", F.when(hash60(seed, key) < F.lit(cut), F.lit("test"))
                         .otherwise(F.lit("train")))
