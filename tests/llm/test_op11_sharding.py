"""Minimax shards against a plain search over the ordered groups."""

import hashlib
import random
import zlib

import pytest

from labelsift.llm import sharding
from tests.llm.data import docs, edge_rows, prose


def digest(text):
    return bytes.fromhex(hashlib.sha256((text or "").encode()).hexdigest()[:32])


def greedy(sizes, cap, shards):
    """Indices of the first group of each further shard, or None."""
    cuts, at, k = [], 0, 1
    for i, s in enumerate(sizes):
        if at + s > cap:
            if k == shards or s > cap:
                return None
            cuts.append(i)
            at, k = 0, k + 1
        at += s
    return cuts


def plain(rows, shards):
    """(doc_id, size, crc, shard, slot) by brute force."""
    groups = {}
    for r in rows:
        groups.setdefault(digest(r[1]), []).append(r)
    size = {k: sum(len((r[1] or "").encode()) + 1 for r in v) for k, v in groups.items()}
    rest, left, own = sum(size.values()), shards, []
    for k in sorted(groups, key=lambda k: (-size[k], k)):
        if left < 2 or size[k] * left <= rest:
            break
        own.append(k)
        rest, left = rest - size[k], left - 1
    order = sorted(k for k in groups if k not in own)
    sizes = [size[k] for k in order]
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(sizes, mid, left) is not None else (mid + 1, hi)
    cuts = greedy(sizes, lo, left) if sizes else []
    shard = {k: sum(c <= i for c in cuts) for i, k in enumerate(order)} | {k: left + i for i, k in enumerate(own)}
    out, slots = [], {}
    for k in sorted(groups):
        for r in sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0)):
            s = shard[k]
            data = (r[1] or "").encode()
            out.append((r[0], len(data) + 1, zlib.crc32(data), s, slots.get(s, 0)))
            slots[s] = slots.get(s, 0) + 1
    return out


def got(spark, rows, shards=sharding.SHARDS, **kw):
    out = sharding.shard_rows(docs(spark, rows, **kw), shards)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_against_brute_force(spark, shards):
    rng = random.Random(shards)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 300]))) for i in range(300)]
    rows += [(1000 + i, rows[rng.randrange(20)][1]) for i in range(80)]
    assert got(spark, rows, shards) == sorted(plain(rows, shards), key=str)


def test_edges_clashes_and_a_hot_text(spark):
    rng = random.Random(2)
    rows = edge_rows()
    assert got(spark, rows, clash=True) == sorted(plain(rows, 8), key=str)
    hot = prose(rng, 60)
    rows = [(i % 40 or None, hot) for i in range(200)] + [(i, prose(rng, 50)) for i in range(200)]
    rows += [(None, None)] * 5 + [(None, "")] * 5
    out = got(spark, rows)
    assert out == sorted(plain(rows, 8), key=str)
    alone = {r[3] for r in out if r[2] == zlib.crc32(hot.encode())}
    assert alone == {7} and sum(r[3] == 7 for r in out) == 200
    loads = [sum(r[1] for r in out if r[3] == s) for s in range(7)]
    assert max(loads) < 1.2 * min(loads)


def test_fewer_groups_than_shards_and_empty_table(spark):
    assert got(spark, [(1, "a"), (2, "a"), (3, "bb")]) == sorted(plain([(1, "a"), (2, "a"), (3, "bb")], 8), key=str)
    assert got(spark, []) == []
    assert got(spark, [(5, None)]) == [(5, 1, 0, 7, 0)]  # above the mean: a shard of its own


@pytest.mark.parametrize("ways", [1, 2, 15])
def test_smallest_capacity_any_width(spark, ways):
    rng = random.Random(ways)
    sizes = [rng.choice([1, 2, 3, 50, 400]) for _ in range(120)]
    rows, at = [], 0
    for i, s in enumerate(sizes):
        at += s
        rows.append((i.to_bytes(2, "big"), at))
    borders = spark.createDataFrame(rows, "key binary, border bigint")
    cap, cuts = sharding.smallest_capacity(borders, 5, at, max(sizes), ways)
    assert greedy(sizes, cap, 5) is not None and greedy(sizes, cap - 1, 5) is None
    assert [sum(sizes[:i]) for i in greedy(sizes, cap, 5)] == cuts


def test_order_of_input_does_not_matter_and_no_python(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(150)]
    a = got(spark, rows)
    rng.shuffle(rows)
    out = sharding.shard_rows(docs(spark, rows).repartition(7))
    assert sorted(map(tuple, out.collect()), key=str) == a
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
