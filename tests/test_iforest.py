"""M1, M2, M5: forest invariants on a planted outlier, path-length maths and
partition invariance."""

import hashlib
import numpy as np
import pytest

from labelsift.operators import iforest as IF
from labelsift.operators import metrics as M
from labelsift.operators import tfidf as T


def test_c_factor():
    assert list(IF.c_factor([0, 1, 2])) == [0.0, 0.0, 1.0]
    m = 256.0
    want = 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    assert abs(IF.c_factor([256])[0] - want) < 1e-9


def test_path_lengths_single_tree():
    # node 0 splits feature 1 at 0.5; left leaf (depth 1, 3 rows), right leaf (depth 1, 1 row)
    f = IF.Forest(feature=np.array([[1, -1, -1]]), threshold=np.array([[0.5, 0, 0]]),
                  left=np.array([[1, 0, 0]]), right=np.array([[2, 0, 0]]),
                  leaf_value=np.array([[np.nan, 1 + IF.c_factor([3])[0], 1.0]]), psi=4, max_depth=2)
    X = np.array([[0.0, 0.1], [0.0, 0.9]])
    got = IF.path_lengths(f, X)
    assert abs(got[0] - (1 + IF.c_factor([3])[0])) < 1e-12 and got[1] == 1.0


@pytest.fixture(scope="module")
def outlier_scores(spark):
    texts = [f"common shared words appear here again {i % 3}" for i in range(300)]
    texts.append("zebra quantum xylophone")
    texts.append("zebra quantum violin")
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    vocab, w = T.fit_transform(df, "row_id", "text", T.TfidfConfig(max_features=50), keep_empty=True)
    vecs = T.vectors(w, "row_id").cache()
    size = vocab.table.count()
    nodes, psi, depth = IF.fit_nodes(vecs, "row_id", size, 302, trees=50, psi=64, seed=7)
    forest = IF.collect_forest(nodes, psi, depth)
    return vecs, size, forest, IF.score(vecs, "row_id", forest, size)


def test_outlier_ranks_first(outlier_scores):
    _, _, forest, sc = outlier_scores
    rows = sorted(sc.collect(), key=lambda r: -r["score"])
    assert {rows[0]["row_id"], rows[1]["row_id"]} == {300, 301}
    assert all(0 < r["score"] < 1 for r in rows)
    assert forest.n_trees == 50 and forest.max_depth == 6


def test_flags_count_and_partition_invariance(spark, outlier_scores):
    vecs, size, forest, sc = outlier_scores
    flagged = M.flag_by_contamination(sc, "score", 0.01, "flag")
    assert 2 <= sum(r["flag"] for r in flagged.collect()) <= 4
    again = IF.score(vecs.repartition(3), "row_id", forest, size)
    a = {r["row_id"]: r["score"] for r in sc.collect()}
    b = {r["row_id"]: r["score"] for r in again.collect()}
    assert a == b
    nodes2, psi, depth = IF.fit_nodes(vecs.repartition(4), "row_id", size, 302, trees=50, psi=64, seed=7)
    f2 = IF.collect_forest(nodes2, psi, depth)
    assert np.array_equal(f2.feature, forest.feature)


def test_tree_samples_are_exact_size(spark):
    keys = spark.range(5000).withColumnRenamed("id", "k")
    s = IF.sample_trees(keys, "k", 5000, trees=20, psi=64, seed=1)
    counts = {r["tree"]: r["count"] for r in s.groupBy("tree").count().collect()}
    assert len(counts) == 20 and set(counts.values()) == {64}


def _plain_sample(n, trees, psi, seed):
    out = set()
    for t in range(trees):
        h = sorted((int(hashlib.md5(f"tree:{seed}:{t // 2}:{k}".encode()).hexdigest()[15 * (t % 2):][:15], 16), k)
                   for k in range(n))
        out |= {(t, k) for _, k in h[:psi]}
    return out


def test_sampling_rule_is_one_rule_at_every_size(spark):
    # above 4 * 200 * 256 rows as below: the psi least draws of all keys
    for n, trees, psi in ((230_000, 3, 64), (900, 5, 64), (40, 3, 64)):
        keys = spark.range(n).withColumnRenamed("id", "k")
        got = {(r["tree"], r["k"]) for r in IF.sample_trees(keys, "k", n, trees=trees, psi=psi, seed=3).collect()}
        assert got == _plain_sample(n, trees, min(psi, n), 3)


def test_small_samples_are_widened_until_whole(spark):
    keys = spark.range(3000).withColumnRenamed("id", "k")
    got = IF.sample_trees(keys, "k", 3000, trees=60, psi=2, seed=5)
    assert {(r["tree"], r["k"]) for r in got.collect()} == _plain_sample(3000, 60, 2, 5)
