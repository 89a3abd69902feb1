"""T1-T9, J3, L6 on small fixtures, checked against hand computations."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from labelsift.operators import tfidf as T


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def test_tokens_fixture(spark):
    df = docs(spark, ["Don't stop! é2 a_b x"])
    got = df.select(T.terms("text", T.TfidfConfig()).alias("t")).first()["t"]
    assert got == ["don", "stop", "é2", "a_b"]


def test_stop_words_then_bigrams(spark):
    cfg = T.TfidfConfig(ngram_max=2, stop_words=T.ENGLISH_STOP_WORDS)
    got = docs(spark, ["the cat and the hat", "a", None]).select(T.terms("text", cfg).alias("t")).collect()
    assert got[0]["t"] == ["cat", "hat", "cat hat"]
    assert got[1]["t"] == [] and got[2]["t"] == []


def test_df_bounds(spark):
    texts = []
    for i in range(20):
        words = ["every"]                       # in 20 docs -> dropped at .95
        if i < 19:
            words.append("most")                # in 19 docs -> kept (19 <= 19)
        if i == 0:
            words.append("once")                # in 1 doc -> dropped by min_df 2
        if i < 2:
            words.append("twice")
        texts.append(" ".join(words))
    v = T.fit(docs(spark, texts), "row_id", "text", T.TfidfConfig(min_df=2, max_df=0.95))
    assert sorted(r["term"] for r in v.table.collect()) == ["most", "twice"]


def test_vocab_tie_break_by_term(spark):
    cfg = T.TfidfConfig(max_features=2)
    v = T.fit(docs(spark, ["bb aa cc", "cc bb aa"]), "row_id", "text", cfg)
    rows = {r["term"]: r["idx"] for r in v.table.collect()}
    assert rows == {"aa": 0, "bb": 1}


def test_weights_match_hand_formula(spark):
    texts = ["apple apple pear", "pear fig", "fig fig fig kiwi"]
    cfg = T.TfidfConfig()
    vocab, w = T.fit_transform(docs(spark, texts), "row_id", "text", cfg)
    got = {(r["row_id"], r["term"]): r["weight"] for r in w.collect()}
    n = 3
    dfs = {"apple": 1, "pear": 2, "fig": 2, "kiwi": 1}
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in dfs.items()}
    raw = {0: {"apple": 2, "pear": 1}, 1: {"pear": 1, "fig": 1}, 2: {"fig": 3, "kiwi": 1}}
    for k, tf in raw.items():
        ws = {t: c * idf[t] for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in ws.values()))
        for t, x in ws.items():
            assert abs(got[(k, t)] - x / norm) < 1e-12


def test_sublinear_and_empty_vector(spark):
    cfg = T.TfidfConfig(sublinear_tf=True, stop_words=T.ENGLISH_STOP_WORDS)
    df = docs(spark, ["tree tree tree", "the and of", "tree leaf"])
    vocab, w = T.fit_transform(df, "row_id", "text", cfg, keep_empty=True)
    vec = {r["row_id"]: (r["indices"], r["values"]) for r in T.vectors(w, "row_id").collect()}
    assert vec[1] == ([], [])                    # only stop words: zero row kept
    assert abs(sum(x * x for x in vec[2][1]) - 1) < 1e-12
    assert len(vec[0][0]) == 1 and abs(vec[0][1][0] - 1.0) < 1e-12


def test_heldout_transform_uses_fitted_vocab(spark):
    cfg = T.TfidfConfig()
    vocab = T.fit(docs(spark, ["alpha beta", "beta gamma"]), "row_id", "text", cfg)
    w = T.transform(docs(spark, ["gamma delta delta"]), "row_id", "text", vocab)
    assert [r["term"] for r in w.collect()] == ["gamma"]


def test_partition_invariance(spark):
    texts = [f"w{i % 7} w{i % 3} common words here {i}" for i in range(60)]
    df = docs(spark, texts)
    cfg = T.TfidfConfig(max_features=10, ngram_max=2)
    a = T.fit_transform(df.repartition(1), "row_id", "text", cfg)[1]
    b = T.fit_transform(df.repartition(5), "row_id", "text", cfg)[1]
    rnd = lambda d: sorted((r["row_id"], r["term"], round(r["weight"], 12)) for r in d.collect())
    assert rnd(a) == rnd(b)


def test_uncapped_vocabulary_index_is_sorted_position(spark):
    # many terms over several partitions: idx must be the term's rank in sort order
    texts = [" ".join(f"w{(i * 7 + j) % 300:03d}" for j in range(12)) for i in range(200)]
    df = docs(spark, texts).repartition(7)
    v = T.fit(df, "row_id", "text", T.TfidfConfig())
    rows = sorted((r["term"], r["idx"]) for r in v.table.collect())
    assert [i for _, i in rows] == list(range(len(rows)))
    assert len(rows) == len({t for t, _ in rows})


def test_no_exchange_carries_text(spark, capsys):
    """Counts and vectors are row-local: on a scan there is no exchange at all,
    on the corpus view at scale (a sort-merge join) only the join's two."""
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(200).select(F.col("id").alias("doc_id"),
                                    F.concat(F.lit("word w"), (F.col("id") % 7).cast("string")).alias("text"))
        lab = spark.range(0, 200, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
        c = d.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "label")
        cfg = T.TfidfConfig(max_features=5)
        vocab = T.fit(c, "row_id", "text", cfg)
        for df, key, n in ((d, "doc_id", 0), (c, "row_id", 2)):
            capsys.readouterr()
            T.vectorize(T.counts(df, key, "text", cfg), key, vocab).explain()
            assert capsys.readouterr().out.count("Exchange") == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_vocabulary_above_the_broadcast_size_gives_the_same_vectors(spark, monkeypatch):
    texts = [f"the common w{i % 30} w{(i * 7) % 40} rare{i}" for i in range(80)] + ["", None, "the"]
    df = docs(spark, texts)
    for cfg in (T.TfidfConfig(), T.TfidfConfig(sublinear_tf=True, ngram_max=2)):
        vocab = T.fit(df, "row_id", "text", cfg)
        c = T.counts(df, "row_id", "text", cfg)
        row = lambda d: sorted((r["row_id"], r["indices"], [round(v, 12) for v in r["values"]])
                               for r in d.collect())
        want = row(T.vectorize(c, "row_id", vocab))
        monkeypatch.setattr(T, "BROADCAST_MAX_TERMS", 6)
        assert row(T.vectorize(c, "row_id", vocab)) == want
        monkeypatch.undo()


def test_columns_and_ml_vectors_ride_along_above_the_broadcast_size(spark, monkeypatch):
    texts = [f"the common w{i % 30} rare{i}" for i in range(60)] + ["", None]
    df = docs(spark, texts).withColumn("label", F.col("row_id") % 3)
    cfg = T.TfidfConfig()
    vocab = T.fit(df, "row_id", "text", cfg)
    c = T.counts(df, "row_id", "text", cfg, ["label", "text"])
    size = vocab.table.count()

    def rows():
        a = sorted((r["row_id"], r["label"], r["text"], r["indices"], [round(v, 12) for v in r["values"]])
                   for r in T.vectorize(c, "row_id", vocab, ["label", "text"]).collect())
        b = sorted((r["row_id"], r["label"], r["features"].size, r["features"].indices.tolist(),
                    [round(v, 12) for v in r["features"].values])
                   for r in T.vectorize(c, "row_id", vocab, ["label"], as_vector=size).collect())
        return a, b

    want = rows()
    monkeypatch.setattr(T, "BROADCAST_MAX_TERMS", 6)
    assert rows() == want and len(want[0]) == 62


def test_counts_equal_the_terms_counted(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["the", "ab", "abc", "ab_c", "zé", "éa", "日本", "\U00010400\U00010401", "\uffe0x", "q1", "of"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(60)] + ["", None, "the of"]
    df = docs(spark, texts)
    for limit in (1, 7, 1 << 21):
        monkeypatch.setattr(T, "CHUNK_TOKENS", limit)
        for cfg in (T.TfidfConfig(), T.TfidfConfig(ngram_max=2),
                    T.TfidfConfig(ngram_max=2, stop_words=T.ENGLISH_STOP_WORDS)):
            plain = {r["row_id"]: Counter(r["t"]) for r in df.select("row_id", T.terms("text", cfg).alias("t")).collect()}
            got = T.counts(df, "row_id", "text", cfg).collect()
            assert len(got) == len(texts)
            for r in got:
                assert [tuple(x) for x in r["counts"]] == sorted(plain[r["row_id"]].items(),
                                                                 key=lambda x: x[0].encode())


def test_row_local_counts(spark):
    got = T.counts(docs(spark, ["b a b c a b", "", None, "z"]), "row_id", "text",
                   T.TfidfConfig(name="x")).collect()
    assert [[tuple(x) for x in r["counts"]] for r in got] == [[], [], [], []]
    got = T.counts(docs(spark, ["bb aa bb cc aa bb", None]), "row_id", "text", T.TfidfConfig()).collect()
    assert [tuple(x) for x in got[0]["counts"]] == [("aa", 2), ("bb", 3), ("cc", 1)]


def test_a_batch_of_counts_is_weighed_in_pieces_of_bounded_size(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"t{(i * 7 + j) % 23}" for j in range(i % 20)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    cfg = T.TfidfConfig(10, 1, 1, 1.0, None, False, "test")
    vocab, counted, _ = T.fit_vectors(df, "k", "text", cfg)
    made = []
    kind = type(counted)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **kw: made.append(f) or whole(self, f, *a, **kw))
    T.vectorize(counted, "k", vocab)
    batch = pa.Table.from_batches(counted.select("k", "counts").toArrow().to_batches()).combine_chunks().to_batches()[0]
    one = list(made[-1](iter([batch])))
    monkeypatch.setattr(T, "CHUNK_TOKENS", 50)
    parts = list(made[-1](iter([batch])))
    assert len(one) == 1 and len(parts) > 5
    size = dict(zip(batch.column("k").to_pylist(), np.diff(np.asarray(batch.column("counts").offsets))))
    assert all(sum(size[k] for k in p.column("k").to_pylist()) <= 50 for p in parts)
    assert pa.Table.from_batches(parts).to_pylist() == one[0].to_pylist()
