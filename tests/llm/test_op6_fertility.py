"""Quality rules: counts and measures against a word-by-word version."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from labelsift.llm import fertility
from labelsift.llm.common import table
from tests.conftest import SF01
from tests.llm.data import docs, edge_rows, prose


def plain_counts(text):
    text = text or ""
    words = text.encode().split()
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if tri[(words[i], words[i + 1], words[i + 2])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words),
            sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def plain_measures(text):
    pieces, level, is_byte = fertility._load(*fertility.default_vocabularies())
    ids, chars, n_level = [], 0, 0
    for w in (text or "").encode().split():
        ids += pieces.encode(w.decode())
        chars += len(w.decode())
        n_level += len(level.encode_ordinary(" " + w.decode()))
    n = max(len(ids), 1)
    h = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    return chars / n, chars / max(n_level, 1), sum(bool(is_byte[i]) for i in ids) / n, h


def rows_for_test():
    rng = random.Random(6)
    return edge_rows() + [
        (20, "a b c a b c a b"), (21, "line\nline\n\n \nline x\nline"), (22, "one two three " * 40),
        (23, "##|| <> x"), (24, "😀 б " * 30 + prose(rng, 60))]


def test_counts_and_measures(spark):
    rows = rows_for_test()
    got = fertility.judge(docs(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), *plain_counts(t), *[round(x, 9) for x in plain_measures(t)]) for k, t in rows)
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   *[round(r[m], 9) for m in fertility.MEASURES]) for r in got)
    assert [w[:6] for w in want] == [h[:6] for h in have]
    assert np.allclose([w[6:] for w in want], [h[6:] for h in have], atol=1e-8)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.method_ok)


def test_byte_fallback_is_measured():
    pieces, _, _ = fertility._load(*fertility.default_vocabularies())
    assert plain_measures("\U00010380\U00010381 ok")[2] > 0.5 and plain_measures("plain words")[2] == 0


def test_bands_reject_outliers_of_a_language_and_keep_the_rest(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 100), "en") for i in range(120)] + \
           [(500, " ".join(f"{c}{c}{c}{i}|{c}" for i, c in enumerate("qzxjkvwy" * 13)), "en")]
    got = {r.doc_id: r for r in fertility.judge(docs(spark, rows)).collect()}
    assert not got[500].base_failed and not got[500].kept
    assert sum(r.kept for k, r in got.items() if k != 500) >= 119


def test_block_size_and_memo_do_not_matter(spark, monkeypatch):
    rows = rows_for_test()
    a = sorted(map(str, fertility.measures(docs(spark, rows)).collect()))
    memo = fertility._Words(fertility.default_vocabularies())
    one = [fertility._measure_block([t or ""], memo) for _, t in rows]
    both = fertility._measure_block([t or "" for _, t in rows], memo)
    for m in both:
        assert [x[m][0] for x in one] == pytest.approx(list(both[m])) if m != "script" else True
    assert len(a) == len(rows)


def test_stage_keeps_whole_rows_and_clean_documents(spark):
    d = table(spark, SF01, "documents")
    kept = fertility.keep_good(d)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    judged = fertility.op6_fertility(spark, SF01).collect()
    assert ids == {r.doc_id for r in judged if r.kept}
    good = {r.doc_id for r in table(spark, SF01, "labels").filter("quality = 1 and toxic = 0").collect()}
    clean = [r for r in judged if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) == len(clean) > 100


def test_empty_table_and_missing_language(spark):
    rows = rows_for_test()
    assert fertility.judge(docs(spark, rows).limit(0)).count() == 0
    assert fertility.judge(docs(spark, [(1, "x y", None)])).count() == 1
    assert fertility.judge(docs(spark, rows).select("doc_id", "text")).count() == len(rows)
    kept = fertility.keep_good(docs(spark, rows, clash=True))
    assert len([r for r in kept.collect() if r.doc_id == 4]) == 2      # repeated rows stay repeated


def test_one_rare_sign_does_not_reject_a_clean_document(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 100), "en") for i in range(60)] + \
           [(500, prose(rng, 60) + " \u20bf", "en"), (501, prose(rng, 100) + " \u20bf", "en")]
    got = {r.doc_id: r for r in fertility.judge(docs(spark, rows)).collect()}
    assert got[500].fallback > 0 and got[501].fallback > 0
    assert got[500].kept and got[501].kept


def test_copies_do_not_set_the_bands(spark):
    rng = random.Random(9)
    copy = prose(rng, 100)
    rows = [(i, copy, "en") for i in range(200)] + [(1000 + i, prose(rng, 100), "en") for i in range(50)]
    got = fertility.judge(docs(spark, rows)).collect()
    assert sum(r.kept for r in got) == len(rows)


def test_one_more_text_flips_no_verdict(spark):
    rng = random.Random(10)

    def text(signs):
        words = prose(rng, 60 - signs).split()
        for i in range(signs):
            words.insert(2 * i, "\u20bf")
        return " ".join(words)

    junk = text(22)
    clean = [(i, text(i % 2), lang) for lang, n in (("aa", 4), ("bb", 28), ("cc", 29), ("dd", 300))
             for i in range(n)]
    rows = clean + [(1000, junk, lang) for lang in ("aa", "bb", "cc", "dd")]
    got = fertility.judge(docs(spark, rows)).collect()
    bad = [r for r in got if r.doc_id == 1000]
    assert all(0.4 < r.fallback < 0.5 and not r.base_failed for r in bad)
    assert [r.kept for r in bad] == [False] * 4
    assert all(r.kept for r in got if r.doc_id != 1000)


def test_kept_against_plain_bands(spark):
    """``kept`` of every document from its measures, by plain Python bands."""
    docs_ = table(spark, SF01, "documents")
    m = {r.doc_id: r for r in fertility.measures(docs_).collect()}
    groups = {}
    for r in m.values():
        if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words:
            g = groups.setdefault((r.lang or r.script, int(math.log2(r.n_words))), {})
            g[r.text_hash] = r

    def band(r, name):
        own = sorted(math.floor(getattr(x, name) * 1000 + 0.5) for x in groups[r.lang or r.script, int(math.log2(r.n_words))].values())
        q1, mid, q3 = (own[math.ceil(len(own) * k / 4) - 1] / 1000 for k in (1, 2, 3))
        least = 0.02 + 4 / max(r.n_tokens, 1) if name == "fallback" else fertility.LEAST[name] * mid
        reach, w = max(fertility.FENCE * (q3 - q1), least), len(own) / (len(own) + fertility.PRIOR)
        low, high = fertility.FIXED[name]
        return w * (q1 - reach) + (1 - w) * low - 1e-9 <= getattr(r, name) <= w * (q3 + reach) + (1 - w) * high + 1e-9

    want = {d for d, r in m.items() if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words
            and all(band(r, x) for x in fertility.MEASURES)}
    for parts in (1, 9):
        got = fertility.judge(docs_.repartition(parts)).collect()
        assert {r.doc_id for r in got if r.kept} == want and len(got) == len(m)
    failed = {r.doc_id for r in got if r.base_failed}
    quality = {r.doc_id: r.quality for r in table(spark, SF01, "labels").collect()}
    poor = [d for d, q in quality.items() if q == 0 and d not in failed]
    good = [d for d, q in quality.items() if q == 1 and d not in failed]
    assert sum(d not in want for d in poor) >= 0.25 * len(poor)
    assert sum(d not in want for d in good) <= 0.01 * len(good)
