"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from labelsift.llm import simhash
from labelsift.llm.common import table
from labelsift.llm.components import components
from tests.conftest import SF01
from tests.llm.data import docs, edge_rows, prose


def plain_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits=4):
    """Component (least index) of each fingerprint over all pairs."""
    n = len(fps)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def wanted(rows):
    fps = [plain_fp(t) for _, t in rows]
    least = {}
    root = roots(fps)
    for (k, _), r in zip(rows, root):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return sorted(str((k, f, least.get(r))) for (k, _), f, r in zip(rows, fps, root))


def as_unsigned(x):
    return x & (1 << 64) - 1


def test_edge_rows(spark):
    rows = edge_rows() + [(60, "a b c"), (61, "A  b\nC"), (62, "a b c d")]
    got = simhash.near_duplicates(docs(spark, rows, clash=True)).collect()
    assert sorted(str((r.doc_id, as_unsigned(r.fp), r.component_id)) for r in got) == wanted(rows)
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    nulls = simhash.near_duplicates(docs(spark, [(None, "a b"), (None, None)])).collect()
    assert [r.component_id for r in nulls] == [None, None]


def fingerprints(spark, values):
    v = np.array(sorted(set(values)), dtype=np.uint64).view(np.int64).tolist()
    return spark.createDataFrame([(x,) for x in v], "fp bigint")


def check_links(spark, values, limit):
    df = fingerprints(spark, values)
    links = [(as_unsigned(r.a), as_unsigned(r.b)) for r in simhash.near_links(df, list_limit=limit).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    vals = sorted(set(values))
    at = {v: i for i, v in enumerate(vals)}
    up = list(range(len(vals)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(at[a]), find(at[b])
        up[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(vals))] == roots(vals)
    return len(links)


@pytest.mark.parametrize("limit", [simhash.LIST_LIMIT, 50, 3])
def test_links_of_dense_groups_chains_and_noise(spark, limit):
    """One dense group (many members in every posting list), chains of
    four-bit steps, pairs spread over four bytes, and random values; with small
    list limits the second index does the work."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    values = [centre]
    for _ in range(250):
        v = centre
        for b in rng.sample(range(64), rng.randrange(7)):
            v ^= 1 << b
        values.append(v)
    for _ in range(10):
        v = rng.getrandbits(64)
        for _ in range(8):
            values.append(v)
            for byte in rng.sample(range(8), 4):
                v ^= 1 << (8 * byte + rng.randrange(8))
    values += [rng.getrandbits(64) for _ in range(300)]
    n = check_links(spark, values, limit)
    assert n < 70 * len(values)


def test_components_of_any_shape(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    edges += [(300 + rng.randrange(30), 300 + rng.randrange(30)) for _ in range(20)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_and_stage_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF01, "documents").collect()]
    got = simhash.op7_simhash(spark, SF01).collect()
    assert sorted(str((r.doc_id, int(r.fingerprint, 16), r.component_id)) for r in got) == wanted(rows)
    d = table(spark, SF01, "documents")
    kept = simhash.keep_one_per_component(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_stage_on_edge_rows(spark):
    rng = random.Random(10)
    other = prose(rng, 70)
    rows = edge_rows() + [(70, other), (70, prose(rng, 70))]       # one id, two texts
    df = docs(spark, rows, clash=True)
    kept = simhash.keep_one_per_component(df).collect()
    near = simhash.near_duplicates(df).collect()
    assert len(kept) == len({r.root for r in near})
    assert len([r for r in kept if r.doc_id == 4]) == 1 and not [r for r in kept if r.doc_id == 5]
    assert simhash.keep_one_per_component(df.limit(0)).count() == 0
