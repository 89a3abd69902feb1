"""Repeated windows against a table of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from labelsift.llm import substrings
from labelsift.llm.common import table
from tests.conftest import SF001
from tests.llm.data import docs, edge_rows, prose


def plain(rows, length):
    seen = Counter()
    raw = [(k, (t or "").encode()) for k, t in rows]
    for _, t in raw:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for k, t in raw:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        n = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out.append((k, len(t), sum(cover), n, kept))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                   for r in substrings.remove_repeats(df, **kw).collect()), key=str)


def test_sliding_minimum_and_runs():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(3) for _ in range(n)) for n in (40, 90, 200)]
    owner, pos, lo, hi = substrings.anchors(texts, length=40, q=8)
    for i, t in enumerate(texts):
        starts = sorted(s for o, p, x, y in zip(owner, pos, lo, hi) if o == i for s in range(p - y, p - x + 1))
        assert starts == list(range(len(t) - 39))
    picks = {}
    for o, p, x, y in zip(owner.tolist(), pos.tolist(), lo.tolist(), hi.tolist()):
        for s in range(p - y, p - x + 1):
            assert picks.setdefault(texts[o][s:s + 40], p - s) == p - s


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages_of_every_kind(spark, seed):
    """Copies with edits, passages just under and over the length, overlaps,
    periodic texts, repeats inside one text."""
    rng = random.Random(seed)
    length = 400
    passages = [prose(rng, n)[:m] for n, m in ((120, 399), (120, 400), (120, 401), (200, 700), (150, 520))]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randrange(5, 120)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(60)
            parts.insert(rng.randrange(len(parts) + 1), p[cut:] if rng.random() < 0.3 else p)
        rows.append((k, "".join(parts)))
    base = prose(rng, 400)
    for k in range(100, 112):       # near copies: one edit each, anywhere
        at = rng.randrange(len(base))
        rows.append((k, base[:at] + "#" + base[at + 1:]))
    rows += [(200, "ab" * 700), (201, "ab" * 450 + "c"), (202, base + base), (203, "é" * 600)]
    assert run(docs(spark, rows).repartition(5), length=length) == plain(rows, length)


def test_edge_rows(spark):
    rows = edge_rows()
    assert run(docs(spark, rows, clash=True)) == plain(rows, 400)
    assert run(docs(spark, rows).limit(0)) == []


def test_many_repeated_rows_do_not_multiply(spark):
    rng = random.Random(9)
    text, other = prose(rng, 200), prose(rng, 200)
    rows = [(1, text)] * 50 + [(2, text[:600] + other)] + [(3, other)]
    assert run(docs(spark, rows)) == plain(rows, 400)


def test_query_on_the_smoke_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in substrings.op4_bucket_refinement(spark, SF001).collect()), key=str)
    want = sorted(((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in plain(rows, 400)), key=str)
    assert got == want and sum(x[2] for x in want) > 0


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs(spark, [(1, "x")]), length=100)


def test_identifiers_name_strings_by_later_offsets():
    """Equal strings and tags get equal numbers at any place and any size; other
    strings, also such that differ in one byte, get others."""
    import numpy as np

    rng = random.Random(4)
    text = bytes(rng.randrange(2) for _ in range(3000)) * 2
    buf = np.frombuffer(text + b"\0" * 8, dtype=np.uint8)
    for size in (8, 9, 15, 16, 17, 64, 337, 400, 511, 512, 736):
        start = np.arange(len(text) - size)
        ids = substrings.identifiers(buf, start, np.full(len(start), size), substrings.EXTENT, start * 0 + 5)
        names = {}
        for s, i in zip(start.tolist(), ids.tolist()):
            assert names.setdefault(text[s:s + size], i) == i
        assert len(set(names.values())) == len(names)
        other = substrings.identifiers(buf, start, np.full(len(start), size), substrings.EXTENT, start * 0 + 6)
        assert not set(other.tolist()) & set(ids.tolist())


@pytest.mark.parametrize("chunk", [1, 97, 1000])
def test_long_texts_are_scanned_in_pieces(spark, monkeypatch, chunk):
    """Any cut of the texts into pieces gives the runs of the whole texts."""
    rng = random.Random(chunk)
    part = prose(rng, 150)
    rows = [(k, part[:rng.randrange(300, 900)] + prose(rng, 90) + part) for k in range(4)] + [(None, "x" * 1500), (9, "ab")]
    for _, t in rows:
        t = t.encode()
        whole = sorted(zip(*(x.tolist() for x in substrings.anchors([t], 400, 64)[1:]))) if len(t) >= 400 else []
        monkeypatch.setattr(substrings, "_CHUNK", chunk)
        got = []
        for a, b, off, piece in substrings._pieces(t, 400, 64):
            got += [(p + off, x, y) for _, p, x, y in zip(*(v.tolist() for v in substrings.anchors([piece], 400, 64)))
                    if a <= p + off < b]
        assert sorted(got) == whole
    import pyarrow as pa

    def runs():
        b = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([7] * len(rows), pa.int64()),
                             pa.array([r[1] for r in rows])], names=["doc_id", "text_hash", "text"])
        return sorted((str(r) for x in substrings._runs(400, 64)([b]) for r in x.to_pylist()))
    cut = runs()
    monkeypatch.setattr(substrings, "_CHUNK", 1 << 18)
    assert cut == runs()


def test_whole_documents_equal_a_plain_window_count(spark):
    from tests.conftest import SF01

    df = table(spark, SF01, "documents")
    assert run(df) == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 400)
