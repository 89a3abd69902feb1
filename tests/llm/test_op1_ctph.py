"""Document fingerprints against a byte-at-a-time version."""

import hashlib
import random

import pytest

from labelsift.llm import ctph
from labelsift.llm.common import table
from tests.conftest import SF001
from tests.llm.data import docs, edge_rows, prose

B64 = ctph._B64


def plain_roll(t: bytes) -> list[int]:
    out = []
    for i in range(len(t)):
        w = [t[i - j] if i >= j else 0 for j in range(7)]
        add = sum((8 - j) * c for j, c in enumerate(w))
        mix = 0
        for j, c in enumerate(w):
            mix ^= c << (5 * j)
        out.append((add + mix) % 2 ** 32)
    return out


def plain(text: str) -> str:
    t = text.encode()
    if not t:
        return "3::"
    roll, k = plain_roll(t), 0
    while 3 * 2 ** k * 64 < len(t):
        k += 1

    def cuts(level):
        return [i + 1 for i, r in enumerate(roll) if r % (3 * 2 ** level) == 3 * 2 ** level - 1]

    while k and len(cuts(k)) + 1 < 32:
        k -= 1

    def sign(level, most):
        edge = [0, *cuts(level)[:most - 1]]
        if edge[-1] < len(t):
            edge.append(len(t))
        out = ""
        for a, b in zip(edge, edge[1:]):
            h = 0
            for r in roll[a:b]:
                v = r * 0x9E3779B97F4A7C15 % 2 ** 64
                h += v ^ (v >> 29)
            h = h * 0xD6E8FEB86659FD93 % 2 ** 64
            h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2 ** 64
            out += B64[h >> 58]
        return out

    return f"{3 << k}:{sign(k, 64)}:{sign(k + 1, 32)}"


def test_fingerprints_equal_the_plain_scan():
    rng = random.Random(1)
    texts = ["", "a", "ab" * 9, "x" * 3000, "Eres " * 500] + [prose(rng, n) for n in (3, 30, 200, 900, 2500)]
    assert ctph.fingerprint_batch([t.encode() for t in texts]) == [plain(t) for t in texts]


def indel(s, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(row[j - 1] if a == b else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def test_edit_distance_and_likeness():
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(64)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(64)))
        assert ctph.edit_distance(s, t) == indel(s, t)
    a = ctph.fingerprint_batch([prose(rng, 500).encode()])[0]
    assert ctph.likeness(a, a) == 1.0
    b = ctph.fingerprint_batch([prose(rng, 500).encode()])[0]
    assert ctph.likeness(a, b) == ctph.likeness(b, a) < 0.3


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 3
        e = t[:len(t) - cut] + nxt[:cut]
        f, g, h = ctph.fingerprint_batch([t.encode(), e.encode(), nxt.encode()])
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g,
                    ctph.likeness(f, g), ctph.likeness(f, h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_neighbours_over_any_number_of_slices(spark, slices):
    rows = [(k, t) for i, (k, t) in enumerate(edge_rows()) if not (k is None and t is None) and i != 5]
    rows = [r for i, r in enumerate(rows) if r not in rows[:i]]
    got = ctph.fingerprint_pairs(docs(spark, rows, clash=True).repartition(4), slices=slices).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_repeated_rows_single_row_and_empty_table(spark):
    rows = edge_rows()
    got = ctph.fingerprint_pairs(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert by_text[(4, by_text and [x for x in got if x.doc_id == 4][0].n_chars)] == \
        {[x for x in got if x.doc_id == 5][0].fingerprint}
    one = ctph.fingerprint_pairs(docs(spark, [(1, "alone in the table")])).first()
    assert one.near_next == 1.0
    assert ctph.fingerprint_pairs(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_query_on_the_smoke_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = ctph.op1_ctph(spark, SF001).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
