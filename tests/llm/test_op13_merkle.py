"""The Merkle manifest against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelsift.llm import merkle
from tests.llm.data import SCHEMA, edge_rows, prose

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """(root, path of each node): a path lists (before, after), lowest first."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fanout * fanout:(k // fanout + 1) * fanout]
            paths[i].append(("".join(run[:k % fanout]), "".join(run[k % fanout + 1:])))
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return (nodes[0] if nodes else None), paths


def plain(rows, fanout=3):
    """(doc_id, leaf, subroot, root, path) of (doc_id, text, lang, source, n_chars) rows."""
    groups = {}
    for d, text, lang, source, n in rows:
        groups.setdefault(source, []).append((d, leaf((d, source, lang, n, text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([h for _, h in groups[s]], fanout)
    root, tops = tree([trees[s][0] for s in order], fanout)
    return [(d, h, trees[s][0], root, p + tops[i]) for i, s in enumerate(order)
            for (d, h), p in zip(groups[s], trees[s][1])]


def check(spark, rows, fanout=3, clash=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:
        df = df.select("*", *[F.lit("x").alias(c) for c in
                              ("tree", "idx", "n", "node", "path", "given", "leaf", "root", "subroot", "place", "c0", "h")])
    out = merkle.manifest(df, COLUMNS, fanout=fanout).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))) \
        .withColumn("proof", merkle.proof(F.col("path"))).collect()
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in out), key=str)
    assert got == sorted(plain(rows, fanout), key=str)
    assert all(r.back == r.root for r in out)
    assert all(r.proof == sha(*[b + a for b, a in r.path]) for r in out)
    return out


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_against_plain_tree(spark, fanout):
    rng = random.Random(fanout)
    sources = ["hot"] * 30 + [None, "", "Z", "a", "é", "日", "one", "two", "three"]
    rows = [(i if i % 17 else None, prose(rng, 5), rng.choice(["en", None]), rng.choice(sources), rng.choice([3, None]))
            for i in range(400)]
    rows += rows[:20] + [(9000, "single", "en", "lone", 1)]
    check(spark, rows, fanout)


def test_edges_and_clashes(spark):
    rows = [(d, t[0] if t else None, "en", f"s{i % 3}", i) for i, (d, *t) in enumerate(edge_rows())]
    check(spark, rows, clash=True)
    check(spark, [(1, "a", "en", "s", 1)])
    check(spark, [(1, None, None, None, None)] * 4)
    check(spark, [(i, "a", "en", f"s{i}", 1) for i in range(11)])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), COLUMNS).count() == 0


def test_a_changed_leaf_is_found(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 8) + "\n" * (i % 3), "en", f"s{i % 4}", 1) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    other = merkle.record([F.col(c) if c != "text" else F.translate("text", "\n", "") for c in COLUMNS])
    out = merkle.manifest(df, COLUMNS, carry={"other": F.sha2(other, 256)}) \
        .withColumn("ok", merkle.folded(F.col("other"), F.col("path")) == F.col("root")).collect()
    assert {r.doc_id for r in out if not r.ok} == {i for i in range(90) if i % 3}


def test_a_record_is_unambiguous(spark):
    rows = [("a", "b"), ("ab", ""), (None, "b"), ("-", "b"), ("1:a", None), ("é", "b"), ("", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [r[0] for r in df.select(merkle.record([F.col("x"), F.col("y")])).collect()]
    assert len(set(got)) == len(rows) and got[5] == "2:é1:b" and got[2] == "-1:b"
