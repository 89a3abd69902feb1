"""Quarantine: held rows wait for a decision of a second stream.

A row is held from its own time on. A decision for its key that comes within
``hold`` releases or drops it; without one it expires when the time is over. This is
a left outer join of two streams within a time range: Spark keeps the waiting rows
as state by key, forgets them when the watermark passes the end of their hold, and
restores them from the checkpoint after a restart. The same function over two batch
tables gives the same rows.

Defined cases: a row without a time or a key cannot be decided and is expired at
once (time) or after its hold (key); a decision delivered twice counts once; several
different decisions within the hold each give a row, so none is lost; a decision
without an answer (null) drops. In a stream, what comes later than ``delay`` after
the newest time seen is ignored, as by any watermark: choose it above the longest
delivery time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quarantine(rows: DataFrame, decisions: DataFrame, key: str, at: str, decided_at: str, release: str,
               hold: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(*columns of rows, status, decided_at)``, status released, dropped or
    expired. Columns of ``decisions`` beside the named three are left behind, so
    none can clash."""
    answers = decisions.select(F.col(key).alias("_key"), F.col(decided_at).alias("_decided"),
                               F.col(release).cast("boolean").alias("_release")).where("_decided IS NOT NULL")
    answers = answers.withWatermark("_decided", delay).dropDuplicates(["_key", "_decided", "_release"])
    timed = rows.where(F.col(at).isNotNull()).withWatermark(at, delay)
    within = (F.col(key) == F.col("_key")) & (F.col("_decided") >= F.col(at)) & \
        (F.col("_decided") <= F.col(at) + F.expr(f"INTERVAL {hold}"))
    status = F.when(F.col("_decided").isNull(), "expired").when(F.col("_release"), "released").otherwise("dropped")
    names = [F.col(f"`{c}`") for c in rows.columns]
    judged = timed.join(answers, within, "left").select(*names, status.alias("status"), F.col("_decided").alias("decided_at"))
    untimed = rows.where(F.col(at).isNull()).select(*names, F.lit("expired").alias("status"),
                                                    F.lit(None).cast("timestamp").alias("decided_at"))
    return judged.unionByName(untimed)


def start_quarantine(judged: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append what is judged to the Parquet table ``sink``; a restart with the same
    ``checkpoint`` goes on with the rows still held."""
    w = judged.writeStream.format("parquet").outputMode("append").option("path", sink) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
