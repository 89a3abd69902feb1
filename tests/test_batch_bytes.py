"""How much of a table a Python worker of the TF-IDF steps is handed at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelsift.operators import tfidf as T
from labelsift.session import ARROW_BATCH, BATCH_BYTES


@pytest.fixture
def unset(spark):
    kept = spark.conf.getAll.get(ARROW_BATCH)
    spark.conf.unset(ARROW_BATCH)
    yield spark
    if kept is None:
        spark.conf.unset(ARROW_BATCH)
    else:
        spark.conf.set(ARROW_BATCH, kept)


def texts(spark, n=4000):
    """About 6 KB a row, 24 MB in one task."""
    return spark.range(0, n, 1, 1).select(
        F.col("id").alias("row_id"), F.concat(F.repeat(F.lit("alpha beta gamma "), 350), F.col("id")).alias("text"))


def handed(df):
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])
    return [(r.size, r.n) for r in df.mapInArrow(run, "size long, n long").toLocalIterator()]


def test_counts_bound_the_batches_of_a_worker(unset):
    df = texts(unset)
    counted = T.counts(df, "row_id", "text", T.TfidfConfig())
    got = handed(df)
    assert max(size for size, _ in got) <= BATCH_BYTES * 1.25 and sum(n for _, n in got) == 4000
    row = counted.where("row_id = 3999").first()
    assert [(c.term, c.tf) for c in row.counts] == [("3999", 1), ("alpha", 350), ("beta", 350), ("gamma", 350)]
    assert counted.count() == 4000


def test_weights_bound_the_batches_of_a_worker(unset):
    df = texts(unset)
    vocab = T.fit(df, "row_id", "text", T.TfidfConfig(max_features=3))
    counted = T.counts(df, "row_id", "text", T.TfidfConfig())
    unset.conf.unset(ARROW_BATCH)
    vecs = T.vectorize(counted, "row_id", vocab)
    assert max(size for size, _ in handed(df)) <= BATCH_BYTES * 1.25
    assert vecs.where(F.size("indices") == 3).count() == 4000


def test_a_value_that_the_session_names_is_kept(unset):
    unset.conf.set(ARROW_BATCH, 1 << 20)
    T.counts(texts(unset, 4), "row_id", "text", T.TfidfConfig())
    assert int(unset.conf.get(ARROW_BATCH).rstrip("b")) == 1 << 20
