"""A1-A6, X1-X3, P9, J1 and the exact order statistics."""

import numpy as np
from pyspark.sql import functions as F

from labelsift.operators import poison as X
from labelsift.operators import profile as A
from labelsift.operators.quantile import exact_percentile, kth_values


def corpus(spark, n, label_of=lambda i: i % 2):
    return spark.createDataFrame([(i, f"text {i}", label_of(i)) for i in range(n)],
                                 "row_id long, text string, label int")


def test_dupes_null_equals_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "text string")
    assert A.duplicate_count(df, "text").first()["n_duplicates"] == 2


def test_label_histogram_excludes_null(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (1,)], "label int")
    got = {r["label"]: r["n"] for r in A.label_distribution(df).collect()}
    assert got == {0: 1, 1: 2}


def test_missing_values_and_length(spark):
    df = spark.createDataFrame([(1, None), (2, "abc"), (None, "héllo")], "a int, text string")
    miss = {r["column_name"]: r["n_missing"] for r in A.missing_values(df).collect()}
    assert miss == {"a": 1, "text": 1}
    st = A.length_stats(df, "text").first()
    assert (st["avg_chars"], st["min_chars"], st["max_chars"]) == (4.0, 3, 5)


def test_overview_and_samples(spark):
    df = corpus(spark, 10)
    o = A.overview(df).first()
    assert (o["n_rows"], o["n_columns"], o["columns"]) == (10, 3, "row_id,text,label")
    assert [r["row_id"] for r in A.head_rows(df).collect()] == [0, 1, 2, 3, 4]
    assert len(A.sample_texts(df).collect()) == 3


def test_flip_exact_size_floor(spark):
    for n, k in ((40, 2), (19, 0), (399, 19)):
        p = X.flip_labels(corpus(spark, n))
        rows = p.collect()
        assert sum(r["is_poisoned"] for r in rows) == k
        for r in rows:
            assert (r["is_poisoned"] == 1) == (r["label"] != r["original_label"])
            if r["is_poisoned"]:
                assert r["label"] == 1 - r["original_label"]


def test_flip_partition_invariant(spark):
    df = corpus(spark, 500)
    a = {r["row_id"] for r in X.poison_index(X.flip_labels(df.repartition(1))).collect()}
    b = {r["row_id"] for r in X.poison_index(X.flip_labels(df.repartition(7, "label"))).collect()}
    assert a == b and len(a) == 25


def test_flip_matches_plain_rank(spark):
    """The no-global-sort draw equals a plain sort on (hash, key)."""
    from labelsift.functions.columns import hash60
    df = corpus(spark, 300)
    hs = sorted((r["h"], r["row_id"]) for r in df.select("row_id", hash60(42, "row_id").alias("h")).collect())
    want = {k for _, k in hs[:15]}
    got = {r["row_id"] for r in X.poison_index(X.flip_labels(df)).collect()}
    assert got == want


def test_mitigate_and_joins(spark):
    p = X.flip_labels(corpus(spark, 100))
    idx = X.poison_index(p)
    assert X.mitigate(p).count() == 95
    c = X.mitigation_counts(p).first()
    assert (c["n_loaded"], c["n_identified"], c["n_removed"], c["n_remaining"]) == (100, 5, 5, 95)
    assert X.poisoned_rows(corpus(spark, 100), idx).count() == 5
    assert X.clean_rows(corpus(spark, 100), idx).count() == 95
    null_mark = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "row_id long, is_poisoned int")
    assert [r["row_id"] for r in X.mitigate(null_mark).collect()] == [1]


def test_kth_values_small_bins(spark):
    """Force several refinement passes with tiny bins / exact limit."""
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 1.5)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    srt = np.sort(vals)
    ranks = [0, 17, 1499, 2600, 3499]
    got = kth_values(df, "v", ranks, bins=8, exact_limit=50)
    assert all(got[r] == srt[r] for r in ranks)
    longs = spark.createDataFrame([(int(x),) for x in rng.integers(0, 1 << 60, 2000)], "v long")
    ls = sorted(r["v"] for r in longs.collect())
    got = kth_values(longs, "v", [5, 1000], bins=4, exact_limit=20)
    assert got[5] == ls[5] and got[1000] == ls[1000]


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.random(1001)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.001, 0.05, 0.5, 0.95):
        assert abs(exact_percentile(df, "v", q) - np.percentile(vals, 100 * q)) < 1e-12


def test_top_k_ties_by_term(spark):
    from labelsift.operators.quantile import top_k
    rows = [(f"t{i:03d}", c) for i, c in enumerate([5, 3, 3, 3, 9, 1, 3, 7])]
    df = spark.createDataFrame(rows, "term string, ctf long")
    got = sorted(r["term"] for r in top_k(df, "ctf", 4, "term").collect())
    want = sorted(t for t, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:4])
    assert got == want == ["t000", "t001", "t004", "t007"]


def test_kth_strings_prefix_refinement(spark):
    from labelsift.operators.quantile import kth_strings, kth_values
    rng = np.random.default_rng(3)
    alphabet = ["a", "b", "é", "z", "日"]
    words = ["".join(rng.choice(alphabet, size=rng.integers(1, 5))) for _ in range(400)]
    words += ["ab", "ab", "abz", "a"] * 5            # duplicates and exact prefixes
    df = spark.createDataFrame([(w,) for w in words], "s string").repartition(5)
    want = sorted(words)
    ranks = [0, 1, 17, 200, len(words) - 1]
    got = kth_strings(df, "s", ranks, exact_limit=7)
    assert got == {r: want[r] for r in ranks}
    # many rows tied on the value: the string tie-break goes through the same search
    tied = spark.createDataFrame([(1, w) for w in words], "v long, t string")
    r = len(words) // 3
    assert kth_values(tied, "v", [r], tiebreak="t", exact_limit=7)[r] == (1, want[r])
