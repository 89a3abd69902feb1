"""Trie-shared token counts against a word-by-word segmentation."""

import random

import pytest

from labelsift.llm import unigram
from labelsift.llm.common import table
from labelsift.llm.pretoken import pretokens
from tests.conftest import SF001
from tests.llm.data import docs, edge_rows


def plain(word, score):
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        best[e] = max((best[s][0] + score[word[s:e]], best[s][1] - 1)
                      for s in range(max(0, e - 128), e) if word[s:e] in score)
    return -best[-1][1], best[-1][0]


def wanted(rows):
    score, _ = unigram.scores(unigram.default_vocabulary())
    memo, out = {}, []
    for k, t in rows:
        words = pretokens(t or "")
        for w in words:
            if w not in memo:
                memo[w] = plain(w.encode(), score)
        out.append((k, len(words), sum(memo[w][0] for w in words),
                    pytest.approx(sum(memo[w][1] for w in words))))
    return out


def test_prefixes_share_nodes():
    c = unigram.TrieCounter(unigram.default_vocabulary())
    score, _ = unigram.scores(unigram.default_vocabulary())
    words = [b"bank", b"banker", b"banking", b"bang", b"ba"]
    assert [c.of(w) for w in words] == [plain(w, score) for w in words]
    assert len(c.best) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_limits_do_not_change_counts(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 400))) for _ in range(8))
             for _ in range(6)]
    a = unigram.TrieCounter(unigram.default_vocabulary())
    one = [a.text(t) for t in texts]
    for name, value in (("MAX_NODES", 50), ("MAX_WORDS", 2), ("TRIE_BYTES", 5)):
        monkeypatch.setattr(unigram, name, value)
    b = unigram.TrieCounter(unigram.default_vocabulary())
    two = [b.text(t) for t in texts]
    assert [x[:2] for x in one] == [x[:2] for x in two]
    assert [x[2] for x in one] == pytest.approx([x[2] for x in two])


def test_edge_rows_and_query(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    got = unigram.token_counts(docs(spark, rows, clash=True)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == sorted(wanted(rows), key=lambda r: r[0])
    assert unigram.token_counts(docs(spark, rows).limit(0)).count() == 0
    assert unigram.token_counts(docs(spark, [(None, None)])).first().n_tokens == 0
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = {r.doc_id: tuple(r) for r in unigram.op9_trie_unigram(spark, SF001).collect()}
    assert len(got) == len(rows) and all(got[w[0]] == w for w in wanted(rows))


def test_blocks_keep_every_row_in_order():
    import pyarrow as pa

    from labelsift.llm.common import blocks
    texts = ["a" * 10, None, "é" * 9, "", "b" * 100, "c", "d" * 30, "e"]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["i", "text"])
    for limit in (1, 25, 40, 1000):
        got = list(blocks([batch, batch.slice(2, 3), batch.slice(0, 0)], limit=limit))
        assert [r for b in got for r in b.column("text").to_pylist()] == texts + texts[2:5]
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= limit
                   for b in got)
