"""How often the vectors are computed, and by how many Python workers of one task."""

from pyspark.sql import functions as F

from labelsift.operators import iforest as IF
from labelsift.operators import scan as S
from labelsift.operators import tfidf as T
from labelsift.plans import detect as D
from labelsift.plans import experiment as E

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]


def rows(spark, n=60):
    return spark.createDataFrame(
        [(i, " ".join(WORDS[(i * 3 + j * j) % 8] for j in range(3 + i % 5)), i % 2) for i in range(n)],
        "row_id long, text string, label int")


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_scan_weighs_only_the_sampled_rows_for_the_forest(spark, monkeypatch):
    weighed = []
    whole = T.vectorize
    monkeypatch.setattr(T, "vectorize", lambda counted, *a, **kw: weighed.append(counted) or whole(counted, *a, **kw))
    drawn = []
    draw = IF.tree_offers
    monkeypatch.setattr(IF, "tree_offers", lambda keys, *a, **kw: drawn.append(keys) or draw(keys, *a, **kw))
    got = S.scan(rows(spark), key="row_id", text_col="text", trees=2, psi=8).scored.collect()
    assert len(got) == 60
    assert len(weighed) == 2 and min(c.count() for c in weighed) <= 16
    assert drawn and all(python_steps(k) == 0 for k in drawn)


def test_forest_of_the_sampled_rows_is_the_forest_of_all(spark):
    vocab, counted, vecs = T.fit_vectors(rows(spark), "row_id", "text", T.TfidfConfig(20))
    one = IF.fit_nodes(vecs, "row_id", vocab.size, 60, trees=5, psi=16)[0]
    two = IF.fit_nodes(vecs, "row_id", vocab.size, 60, trees=5, psi=16, keys=counted.select("row_id"),
                       vectors_of=lambda k: T.vectorize(counted.join(F.broadcast(k), "row_id", "left_semi"),
                                                        "row_id", vocab))[0]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_detector_scores_written_vectors(spark, monkeypatch):
    seen = []
    score = IF.score
    monkeypatch.setattr(IF, "score", lambda vecs, *a, **kw: seen.append(vecs) or score(vecs, *a, **kw))
    det = D.detect(rows(spark).withColumn("is_poisoned", F.lit(0)), trees=5, psi=16)
    assert det.scores.count() == 60
    assert [python_steps(v) for v in seen] == [0]


def test_held_out_rows_are_weighed_from_written_counts(spark, monkeypatch):
    monkeypatch.setattr(E, "corpus", lambda spark, sf: rows(spark))
    weighed = []
    frame = E._frame
    monkeypatch.setattr(E, "_frame", lambda counted, *a: weighed.append(counted) or frame(counted, *a))
    cfg = T.TfidfConfig(20)
    E.impact(spark, "", cfg=cfg).collect()
    assert E.fitted_model(spark, "", True, cfg=cfg).count() == 1
    assert len(weighed) == 4 and all(python_steps(c) == 0 for c in weighed)
