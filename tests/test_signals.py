"""Label-noise signals: similarity join, ranks, confident joint, weighted fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsift.operators import ranks as R
from labelsift.operators import similarity as SIM
from labelsift.operators import tfidf as T
from labelsift.plans import signals as S

WORDS = [f"w{i}" for i in range(40)]
CFG = T.TfidfConfig(1000, 1, 1, 1.0, None, False, "test")


def near_texts(seed, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies, some of them of a very common text
        words = (texts[0] if i % 2 else texts[i]).split()
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    return texts + texts[:5] + ["", "common common"] * 3


@pytest.mark.parametrize("threshold,block", [(0.8, 512), (0.5, 3), (0.7, 1)])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(SIM, "BLOCK", block)
    texts = sorted(set(near_texts(block)))
    df = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    vocab, _, vecs = T.fit_vectors(df, "rep", "text", CFG)
    full = {r["rep"]: dict(zip(r["indices"], r["values"])) for r in vecs.collect()}
    want = {}
    for a in full:
        for b in full:
            if a < b:
                c = sum(v * full[b].get(i, 0.0) for i, v in full[a].items())
                if c >= threshold:
                    want[a, b] = round(c, 9)
    got = {(r["a"], r["b"]): round(r["cosine"], 9) for r in SIM.similar_pairs(vecs, vocab, "rep", threshold).collect()}
    assert got == want and len(want) > 5


def test_tiles_of_any_size_find_the_pairs_of_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    dense = (rng.random((10, 30)) * (rng.random((10, 30)) < 0.4))[rng.integers(0, 10, 150)]
    dense += rng.random((150, 30)) * (rng.random((150, 30)) < 0.2)
    dense[:, 0] += 0.1  # one term in every row
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    start = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    rows = SIM._Rows(start, np.nonzero(dense)[1], dense[dense > 0])
    whole = dense @ dense.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if whole[i, j] >= 0.8}
    across = {(i, j) for i in range(70) for j in range(80) if whole[i, j + 70] >= 0.8}
    assert len(want) > 50
    for cells in (1 << 23, 1):  # one tile; tiles of 64 rows
        monkeypatch.setattr(SIM, "_CELLS", cells)
        for a, b, same, pairs in ((rows, rows, True, want), (rows.part(0, 70), rows.part(70, 150), False, across)):
            got = [(int(x), int(y), z) for i, j, c in SIM._tiles(a, b, same, 0.8) for x, y, z in zip(i, j, c)]
            assert len(got) == len(pairs) and {g[:2] for g in got} == pairs
            assert all(abs(z - whole[x, y + (0 if same else 70)]) < 1e-12 for x, y, z in got)
            for t in (0.8, *sorted(g[2] for g in got)[::25]):  # also a threshold that a pair meets exactly
                some = {(int(x), int(y)) for i, j, _ in SIM._tiles(a, b, same, t, exact=False) for x, y in zip(i, j)}
                assert some == {g[:2] for g in got if g[2] >= t}


def test_neighbour_sums_are_summed_where_pairs_are_found(spark, monkeypatch):
    monkeypatch.setattr(SIM, "BLOCK", 9)
    df = spark.createDataFrame([(i, t, i % 5) for i, t in enumerate(sorted(set(near_texts(9))))], "rep long, text string, n0 long")
    vocab, _, vecs = T.fit_vectors(df, "rep", "text", CFG, carry=("n0",))
    want = {}
    for r in SIM.similar_pairs(vecs, vocab, "rep", 0.6).collect():
        for x, y in ((r["a"], r["b"]), (r["b"], r["a"])):
            want[x] = want.get(x, 0) + y % 5
    sums = SIM.neighbour_sums(vecs, "rep", ("n0",), 0.6)
    assert {r["rep"]: r["n0"] for r in sums.collect()} == want and len(want) > 10
    assert "Join" not in sums._jdf.queryExecution().sparkPlan().toString()  # no table of pairs meets the vectors


def test_vectors_are_written_once_and_meet_without_a_shuffle(spark, monkeypatch):
    """Whatever the number of blocks, each vector lies in one of them, none is dealt
    out to the others, and a block keeps to its vectors and entries."""
    df = spark.createDataFrame(list(enumerate(sorted(set(near_texts(4))))), "rep long, text string")
    vocab, _, vecs = T.fit_vectors(df, "rep", "text", CFG)
    want = {r["rep"]: (r["indices"], r["values"]) for r in vecs.collect() if r["indices"]}
    for block, entries in ((4, 1 << 19), (512, 40)):
        monkeypatch.setattr(SIM, "BLOCK", block)
        monkeypatch.setattr(SIM, "_ENTRIES", entries)
        got, rows = {}, SIM._blocks(vecs, "rep", ()).collect()
        for r in rows:
            keys, sizes = np.frombuffer(r["rep"], np.int64), np.frombuffer(r["sizes"], np.int32)
            assert len(keys) <= block and (sizes.sum() <= entries or len(sizes) == 1)
            for k, i, v in zip(keys, *(np.split(np.frombuffer(r[c], t), np.cumsum(sizes)[:-1])
                                       for c, t in (("indices", np.int32), ("values", np.float64)))):
                assert k not in got
                got[k] = (list(i), list(v))
        assert got == want and len(rows) > 8 and len({r["block"] for r in rows}) == len(rows)
        plan = SIM.similar_pairs(vecs, vocab, "rep")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        sums = SIM.neighbour_sums(vecs.withColumn("n0", F.lit(1)), "rep", ("n0",))
        plan = sums._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" in plan and "Groups" not in plan


def test_consistency_counts_copies_without_pairing_them(spark):
    rows = [(i, "same words in this text", int(i % 4 == 0)) for i in range(40)] + \
        [(100, "same words in this text indeed", 1), (101, "nothing alike here", 0), (102, None, 1), (103, "", 1), (104, "", 0)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    cfg = T.TfidfConfig(1000, 1, 1, 1.0, None, False, "t")
    got = {r["row_id"]: r for r in SIM.label_consistency(df, cfg=cfg, threshold=0.5).collect()}
    assert len(got) == len(rows)
    assert got[1]["neighbours"] == 40 and got[1]["same"] == 29 and got[1]["consistent"]
    assert got[0]["vote"] == 0 and not got[0]["consistent"] and not got[100]["consistent"]
    assert got[101]["neighbours"] == 0 and got[101]["vote"] is None and got[101]["consistent"]
    assert got[103]["neighbours"] == 2 and got[104]["vote"] == 1  # null counts as empty


def test_text_classes_deal_texts_out_once(spark):
    """Keys may repeat or be null; a class is taken from a row of its least key."""
    rows = [(3, "a b", 1), (2, "a b", 0), (2, "a b", 0), (5, "c", None), (None, "c", 1), (None, "d", 1), (7, None, 0), (8, "", 1)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int").repartition(3)
    reps, members = SIM.text_classes(df, "row_id", "text", "label")
    assert sorted(map(tuple, reps.collect())) == [(2, "a b", 2, 1), (5, "c", 0, 1), (7, "", 1, 1)]
    assert sorted(map(tuple, members.collect()), key=str) == sorted(
        [(3, 1, 2), (2, 0, 2), (2, 0, 2), (5, None, 5), (None, 1, 5), (None, 1, None), (7, 0, 7), (8, 1, 7)], key=str)
    same = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "y", 1)], "row_id long, text string, label int")
    assert [r["rep"] for r in SIM.text_classes(same, "row_id", "text", "label")[0].collect()] == [1]  # one row a key
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reps.select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.toString().split("\n") if "Exchange" in x]
    assert sum("at#" in x for x in dealt) == 2 and len(dealt) == 3, dealt  # the texts, the classes twice


def test_mid_ranks_with_ties_and_nulls(spark):
    rng = random.Random(3)
    vals = [rng.choice([1.0, 1.0, 2.0, rng.random(), None]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, v double").repartition(5)
    got = {r["k"]: r["v_rank"] for r in R.mid_ranks(df, ["v"]).collect()}
    s = sorted(v for v in vals if v is not None)
    for k, v in enumerate(vals):
        if v is None:
            assert got[k] is None
        else:
            places = [i for i, x in enumerate(s) if x == v]
            assert math.isclose(got[k], sum(places) / len(places) / (len(s) - 1))
    one = R.mid_ranks(spark.createDataFrame([(1, 5.0)], "k long, v double"), ["v"]).first()
    assert one["v_rank"] == 0.5
    assert R.mid_ranks(df.limit(0), ["v"]).count() == 0


def test_rank_vote_median(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), float(i * i)) for i in range(11)], "k long, a double, b double, c double")
    got = {r["k"]: (r["vote"], r["marked"]) for r in R.rank_vote(df, ["a", "b", "c"], 0.25).collect()}
    assert got[10] == (1.0, True) and got[0] == (0.0, False) and got[5] == (0.5, False)


def test_confident_joint_and_relabel(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.6)
        p = min(max(rng.gauss(0.8 if y else 0.2, 0.2), 0.01), 0.99)
        rows.append((i, 1 - y if i % 12 == 0 else y, p))
    df = spark.createDataFrame(rows, "row_id long, label int, probability double")
    own = lambda r: r[2] if r[1] else 1 - r[2]
    t = {g: np.mean([own(r) for r in rows if r[1] == g]) for g in (0, 1)}

    def likely(p):
        a, b = p >= t[1], 1 - p >= t[0]
        return (int(p > 0.5) if a and b else 1 if a else 0 if b else None)

    cells = {(g, k): sum(1 for r in rows if r[1] == g and likely(r[2]) == k) for g in (0, 1) for k in (0, 1)}
    joint, _ = S.confident_joint(df)
    assert {(r["given"], r["likely"]): r["n"] for r in joint.collect()} == cells
    want = set()
    for g in (0, 1):
        mine = sorted((round(own(r), 4), r[0]) for r in rows if r[1] == g)
        k = math.floor(cells[g, 1 - g] * len(mine) / (cells[g, 0] + cells[g, 1]) + 0.5)
        want |= {i for _, i in mine[:k]}
    got = S.relabel(df).collect()
    assert {r["row_id"] for r in got if r["suspect"]} == want and want
    assert all(r["new_label"] == (1 - r["label"] if r["suspect"] else r["label"]) for r in got)


def test_out_of_fold_never_sees_the_row_and_weights_have_the_right_gradient(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[:20] if i % 2 else WORDS[15:]) for _ in range(12)), i % 2, 0.2 + (i % 5) / 5)
            for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int, weight double")
    got = S.out_of_fold(df, cfg=CFG).collect()
    assert len(got) == 120 and {r["fold"] for r in got} == {0, 1, 2}
    assert all(math.isclose(r["loss"], -math.log(r["probability"] if r["label"] else 1 - r["probability"]), rel_tol=1e-6)
               for r in got)
    assert np.mean([(r["margin"] > 0) == (r["label"] == 1) for r in got]) > 0.9
    model, held, total, n = S.fit_weighted(df, df, "weight", cfg=CFG)
    assert n == 120 and math.isclose(total, sum(r[3] for r in rows))
    frame = {r["row_id"]: r["features"].toArray() for r in held.collect()}
    x = np.array([frame[r[0]] for r in rows])
    y, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    z = x @ model.coefficients.toArray() + model.intercept
    g = w * (1 / (1 + np.exp(-z)) - y)
    assert abs(x.T @ g + model.coefficients.toArray()).max() < 1e-4 and abs(g.sum()) < 1e-4


def test_term_counts_outside_every_fold_come_from_one_pass(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near_texts(4))] + [(None, "w1 w2")], "k long, text string")
    counted = T.counts(df, "k", "text", CFG).withColumn("fold", S.fold("k", 3))
    one = S.fold_doc_freq(counted, 3)
    assert one._jdf.queryExecution().sparkPlan().toString().count("Generate") == 1
    for k in range(3):
        want = T.doc_freq_from_counts(T.explode_counts(counted.where(F.col("fold") != k), "k")).collect()
        got = one.where(f"df_{k} > 0").select("term", f"df_{k}", f"ctf_{k}").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
