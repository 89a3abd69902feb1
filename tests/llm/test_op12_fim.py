"""Fill-in-middle against a plain version, and exact round trips."""

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from labelsift.llm import fim
from tests.llm.data import docs, edge_rows, prose

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm_rate:
        return (doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}")
    return (doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def check(spark, rows, **kw):
    out = fim.fill_in_middle(docs(spark, rows, **{k: v for k, v in kw.items() if k == "clash"}),
                             **{k: v for k, v in kw.items() if k != "clash"})
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    opts = {k: v for k, v in kw.items() if k != "clash"}
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((plain(r[0], r[1], **opts) for r in rows), key=str)
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in rows)
    return got


def test_units_cover_texts():
    texts = ["", " ", "a", " a ", "a  b\n\tc \r\n", "\x00 \xa0é\x0b日本 \x1c", "x" * 100 + "\n\n", "\n\n a", "ÿ þÿ"]
    got = fim.split_units(pa.array(texts, pa.string())).to_pylist()
    assert [[u.decode() for u in g] for g in got] == [UNIT.findall(t) for t in texts]


def test_against_plain_version(spark):
    rng = random.Random(1)
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\x0b\x0c", " \n "]
    words = ["a", "é", "日本", "😀", "x<P", "S>", "<", "M>", "<S", "\x00", "\xa0", "ordinary", "\x85", "<<", ">"]
    rows = [(i, "".join(rng.choice(blanks) * rng.randrange(2) + rng.choice(words)
                        for _ in range(rng.randrange(30))) + rng.choice(["", " ", "\n"])) for i in range(600)]
    got = check(spark, rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert {r.form for r in check(spark, rows[:60], rate=100, spm_rate=0)} <= {"plain", "psm"}
    check(spark, rows[:60], seed=7, rate=100, spm_rate=100)


def test_edges_clashes_sentinels_repeats(spark):
    rows = edge_rows() + [(i, f"text {s} with a sentinel") for i, s in enumerate(("<P>", "<S>", "<M>"))]
    rows += [(i, " \n") for i in range(20)] + [(i, "w") for i in range(20)] + [(77, "same words here")] * 5
    check(spark, rows, clash=True)
    check(spark, rows, rate=100)
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


def test_long_text_and_blocks(spark):
    rng = random.Random(4)
    long = prose(rng, 1_000_000)
    rows = [(i, long if i == 3 else prose(rng, 20)) for i in range(8)]
    check(spark, rows, rate=100)
