"""String-kernel language identification: held-out accuracy, the kernel against
a set-based version, and edge cases."""

import numpy as np
from zlib import crc32

from labelsift.llm import langid
from labelsift.llm.common import table
from tests.conftest import SF01
from tests.llm.data import docs, edge_rows


def test_presence_is_the_set_of_ngrams():
    texts = ["hello wörld", "aa", "b", "xyz xyz"]
    classes = langid._byte_classes()
    rows, cols = langid._presence([t.encode() for t in texts], classes, langid._BASE)
    b = langid._BASE
    for i, t in enumerate(texts):
        c = [int(classes[x]) for x in t.encode()]
        want = {x for x in c} | {b + x * b + y for x, y in zip(c, c[1:])} \
            | {b + b * b + (x * b + y) * b + z for x, y, z in zip(c, c[1:], c[2:])}
        assert set(cols[rows == i].tolist()) == want


def test_batched_scores_do_not_depend_on_the_block(spark, monkeypatch):
    d = table(spark, SF01, "documents").select("doc_id", "text", "lang")
    model = langid.fit(d, per_lang=60, landmarks=40)
    texts = [r.text for r in d.limit(40).collect()]
    whole = model.scores(texts)
    one = np.concatenate([model.scores([t]) for t in texts])
    monkeypatch.setattr(langid, "_CELLS", 1)
    assert np.allclose(whole, one) and np.allclose(whole, model.scores(texts))


def test_query_is_accurate_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF01, "documents").collect()}
    got = langid.op2_string_kernel(spark, SF01).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.98


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "the house of stone", "en") for i in range(40) if crc32(str(i).encode()) % 4 != 2] \
        + [(i, "das haus aus stein", "de") for i in range(40) if crc32(str(i).encode()) % 4 == 2]
    got = langid.identify(docs(spark, rows)).collect()
    assert {r.lang_pred for r in got} == {"en"}


def test_edge_cases(spark):
    rows = [(*r, "en" if i % 2 else None) for i, r in enumerate(edge_rows())]
    rows += [(100 + i, "the cat and the dog", "en") for i in range(6)] + \
            [(200 + i, "le chat et le chien", "fr") for i in range(6)]
    got = langid.identify(docs(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in (1, 2, 3, 11):
        assert by[k].lang_pred == "und" and by[k].score == 0.0
    assert by[100].lang_pred == "en" and by[200].lang_pred == "fr"
    empty = docs(spark, rows).limit(0)
    assert langid.identify(empty).count() == 0
    none = langid.identify(docs(spark, [(1, "some text", None)])).first()
    assert none.lang_pred == "und"
