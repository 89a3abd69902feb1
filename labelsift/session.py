"""Session helpers: building a session, the checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Session defaults (runtime SQL settings). On a cluster they apply only where
# the submitted configuration leaves a setting unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Launch-time settings for local runs (tests, bench): no web UI; checkpoint
# files are removed once the frames that read them are garbage-collected.
_LOCAL = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "labelsift",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass ``master=None`` and let
    spark-submit decide: settings it names (shuffle partitions, AQE, ...)
    are kept, and ours fill only the gaps. Tests and the bench pass
    ``local[N]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        for k, v in _LOCAL.items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    submitted = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if not submitted.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``labelsift`` importable in the Python workers.

    Pandas UDFs (forest growth and scoring) are pickled by reference to this
    package, so executors need it on their path. Once per SparkContext the
    package's sources are zipped on the driver and added with ``addPyFile``
    (what ``--py-files`` does at submit time); Spark ships the zip to every
    executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_labelsift_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="labelsift-pkg-"), "labelsift.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    sc._labelsift_shipped = True


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to the Python workers in Arrow batches of ``BATCH_BYTES`` (a
    longer row alone) instead of Spark's 64 MB: a worker holds the batch it works
    on and the one before, so the batch sets its memory. A value that the session
    names is kept."""
    if ARROW_BATCH not in spark.conf.getAll:
        spark.conf.set(ARROW_BATCH, BATCH_BYTES)


def is_local(master: str) -> bool:
    """One JVM on this machine: ``local``, ``local[N]``, ``local[*, F]``."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (a shared folder on a cluster) wins. Where it is
    unset, a ``local[...]`` master (tests, the bench, the smoke entry) gets a
    fresh scratch folder; any other master raises, as the nodes of a cluster
    cannot read one machine's folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share "
                             f"(master {sc.master!r} runs on more than this machine)")
        configured = tempfile.mkdtemp(prefix="labelsift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back: a
    lineage cut for wide intermediates (rows with text), compressed and
    column-pruned when read again. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPLIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a *small* input over all cores before per-row work: one
    file of one row group is one task otherwise. Only where the planner's size
    estimate is under one split a core, so what moves is bounded by the cluster
    and not by the data; larger inputs (and joins, whose estimate is their
    product) pass unchanged and are never shuffled for this. Rows and results
    are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def materialize(df: DataFrame, reliable: bool = True) -> DataFrame:
    """Cut lineage of an intermediate that is read several times.

    ``reliable=True`` writes a checkpoint into the shared checkpoint folder,
    so a lost executor does not force recomputation of the whole upstream
    plan. ``reliable=False`` only persists (memory, spilling to disk) and is
    meant for cheap, small intermediates.
    """
    if reliable:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def run_concurrently(calls: list[tuple]) -> list:
    """Run independent driver-side steps -- each launching its own Spark
    jobs -- from threads, so their jobs share the cluster instead of queueing
    (as ``CrossValidator(parallelism=...)`` does). ``calls`` holds
    ``(callable, *args)`` tuples; results come back in the same order."""
    if len(calls) <= 1:
        return [c[0](*c[1:]) for c in calls]
    with ThreadPoolExecutor(max_workers=len(calls)) as pool:
        futures = [pool.submit(c[0], *c[1:]) for c in calls]
        return [f.result() for f in futures]
