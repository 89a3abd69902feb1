"""Streaming screen.

``fit_screen`` fits the screen once on a batch table: TF-IDF vocabulary,
isolation forest and the contamination offset of the training scores.
``start_screen_stream`` then scores files as they arrive with
``foreachBatch``: every micro-batch is a bounded DataFrame that goes through
the same batch operators (row-local counts, vocabulary look-up, forest
``mapInArrow``) and the fitted offset, so a new row is flagged exactly as the
fitted detector would flag it. Output is appended to a table under the query's
checkpointed progress; with the screen saved by ``save_screen``, a restarted
driver resumes with the same model.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelsift.operators import iforest as IF
from labelsift.operators import metrics as M
from labelsift.operators import tfidf as T
from labelsift.session import materialize


SETTINGS = ("psi int, max_depth int, n_features int, offset double, contamination double, n_docs bigint, "
            "config string")


@dataclass
class FittedScreen:
    vocab: T.Vocabulary
    forest: IF.Forest
    n_features: int
    offset: float
    contamination: float


def fit_screen(df: DataFrame, key: str, text: str, cfg: T.TfidfConfig = T.SCAN,
               contamination: float | None = None, trees: int = 200, psi: int = 256,
               seed: int = 42) -> FittedScreen:
    from labelsift.plans.detect import featurize
    n = df.count()
    c = contamination if contamination is not None else M.contamination_for(n)
    vecs, size, vocab = featurize(df, key, text, cfg, n)
    nodes, psi_eff, depth = IF.fit_nodes(vecs, key, size, n, trees, psi, seed)
    forest = IF.collect_forest(nodes, psi_eff, depth).compact(size)
    scored = materialize(IF.score(vecs, key, forest, size))
    offset = M.contamination_offset(scored, "score", c)
    return FittedScreen(vocab, forest, size, offset, c)


def save_screen(fitted: FittedScreen, path: str) -> None:
    """Write a fitted screen: vocabulary, forest nodes and one row of settings."""
    spark = fitted.vocab.table.sparkSession
    f, cfg = fitted.forest, fitted.vocab.cfg
    used = np.flatnonzero(f.lookup >= 0)[np.argsort(f.lookup[f.lookup >= 0])] if f.lookup is not None else None
    live = ~np.isnan(f.leaf_value) | (f.feature >= 0)
    t, n = np.nonzero(live)
    feat = f.feature[t, n]
    if used is not None and used.size:
        feat = np.where(feat >= 0, used[np.maximum(feat, 0)], -1)
    nodes = pd.DataFrame({"tree": t.astype("int32"), "node": n.astype("int32"), "feature": feat.astype("int32"),
                          "threshold": f.threshold[t, n], "left": f.left[t, n].astype("int32"),
                          "right": f.right[t, n].astype("int32"), "leaf_value": f.leaf_value[t, n]})
    fitted.vocab.table.write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark.createDataFrame(nodes, IF.NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    row = (f.psi, f.max_depth, fitted.n_features, fitted.offset, fitted.contamination, fitted.vocab.n_docs,
           json.dumps(asdict(cfg)))
    spark.createDataFrame([row], SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_screen(spark: SparkSession, path: str) -> FittedScreen:
    """Read what ``save_screen`` wrote."""
    r = spark.read.parquet(f"{path}/settings").first()
    cfg = json.loads(r["config"])
    cfg["stop_words"] = tuple(cfg["stop_words"]) if cfg["stop_words"] else None
    vocab = T.Vocabulary(spark.read.parquet(f"{path}/vocabulary"), r["n_docs"], T.TfidfConfig(**cfg))
    vocab.size = vocab.table.count()
    forest = IF.collect_forest(spark.read.parquet(f"{path}/nodes"), r["psi"], r["max_depth"])
    return FittedScreen(vocab, forest.compact(r["n_features"]), r["n_features"], r["offset"], r["contamination"])


def screen_batch(df: DataFrame, key: str, text: str, fitted: FittedScreen) -> DataFrame:
    """Score a bounded DataFrame with a fitted screen:
    ``(key, score, anomaly_score, potentially_suspicious)``."""
    vecs = T.vectorize(T.counts(df, key, text, fitted.vocab.cfg), key, fitted.vocab)
    s = IF.score(vecs, key, fitted.forest, fitted.n_features)
    out = M.apply_offset(s, "score", fitted.offset, "_flag", "anomaly_score")
    return out.select(key, "score", "anomaly_score", (F.col("_flag") == 1).alias("potentially_suspicious"))


def start_screen_stream(spark: SparkSession, source: str, schema, key: str, text: str,
                        fitted: FittedScreen, sink: str, checkpoint: str,
                        fmt: str = "parquet", available_now: bool = False) -> StreamingQuery:
    """Stream ``source`` (files of ``fmt`` with ``schema``) through the screen
    into the parquet table ``sink``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        scored = screen_batch(batch, key, text, fitted).withColumn("batch_id", F.lit(batch_id))
        # a replayed batch id rewrites only its own partition
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("batch_id").parquet(sink))

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
