"""Source reliability by expectation-maximisation, versions by hash trees."""

import random

import pytest
from pyspark.sql import functions as F

from labelsift.operators import reliability as REL
from labelsift.operators import versions as V


def plain_em(rows, m, rounds):
    """Row by row, without patterns."""
    hit, false = [REL.START_HIT] * m, [REL.START_FALSE] * m
    share = {s: REL.START_BAD for s, _ in rows}
    for _ in range(rounds):
        post = []
        for s, marks in rows:
            bad, sound = share[s], 1 - share[s]
            for j, on in enumerate(marks):
                bad *= hit[j] if on else 1 - hit[j]
                sound *= false[j] if on else 1 - false[j]
            post.append(bad / (bad + sound))
        w = REL.PSEUDO
        for s in share:
            mine = [p for (o, _), p in zip(rows, post) if o == s]
            share[s] = (sum(mine) + w * REL.START_BAD) / (len(mine) + w)
        for j in range(m):
            hit[j] = (sum(p for (_, k), p in zip(rows, post) if k[j]) + w * REL.START_HIT) / (sum(post) + w)
            false[j] = (sum(1 - p for (_, k), p in zip(rows, post) if k[j]) + w * REL.START_FALSE) / (len(rows) - sum(post) + w)
    return share, hit, false


def planted(seed=3):
    rng = random.Random(seed)
    rows = []
    for s, n, bad in (("good", 400, 0.02), ("mixed", 60, 0.3), (None, 50, 0.8), ("tiny", 1, 0.0)):
        for _ in range(n):
            b = rng.random() < bad
            rows.append((s, tuple(rng.random() < (0.8 if b else 0.05) for _ in range(3))))
    return rows


def test_reliability_equals_row_by_row_rounds(spark):
    rows = planted()
    df = spark.createDataFrame([(s, *k) for s, k in rows], "source string, a boolean, b boolean, c boolean")
    got, rates = REL.reliability(df.repartition(5), "source", ["a", "b", "c"], 6)
    share, hit, false = plain_em(rows, 3, 6)
    out = {r["source"]: r for r in got.collect()}
    assert set(out) == {"good", "mixed", None, "tiny"}
    for s, r in out.items():
        assert r["bad_share"] == pytest.approx(share[s], abs=1e-9) and r["n_rows"] == sum(o == s for o, _ in rows)
    assert [r["hit"] for r in rates] == pytest.approx(hit, abs=1e-9)
    assert [r["false_alarm"] for r in rates] == pytest.approx(false, abs=1e-9)


def test_reliability_finds_planted_sources(spark):
    df = spark.createDataFrame([(s, *k) for s, k in planted()], "source string, a boolean, b boolean, c boolean")
    out = {r["source"]: r["reliability"] for r in REL.reliability(df, "source", ["a", "b", "c"])[0].collect()}
    assert out["good"] > 0.9 and abs(out["mixed"] - 0.7) < 0.15 and out[None] < 0.4


def test_reliability_of_nulls_and_nothing(spark):
    schema = "source string, a boolean, extra int"
    empty, rates = REL.reliability(spark.createDataFrame([], schema), "source", ["a"])
    assert empty.count() == 0 and rates == [{"signal": "a", "hit": REL.START_HIT, "false_alarm": REL.START_FALSE}]
    some = spark.createDataFrame([("x", None, 1), ("x", False, 1)], schema)
    same = spark.createDataFrame([("x", False, 1), ("x", False, 2)], schema)
    assert REL.reliability(some, "source", ["a"])[0].collect() == REL.reliability(same, "source", ["a"])[0].collect()
    with pytest.raises(ValueError):
        REL.reliability(some, "source", [])


SCHEMA = "id long, text string, n int"


def version(spark, tmp_path, name, rows, columns=("id", "text", "n")):
    path = str(tmp_path / name)
    V.commit(spark.createDataFrame(rows, SCHEMA).repartition(3).select(*columns), "id", path)
    return path


def test_changes_equal_a_full_outer_join(spark, tmp_path):
    old = [(i, f"t{i}", i % 3) for i in range(300)] + [(None, "a", 1), (7, "again", 0)]
    new = [r for r in old if r[0] not in (5, 70)] + [(1000, "n", 1), (1001, None, None)]
    new = [(i, None if i == 9 else t, 8 if i == 11 else n) for i, t, n in new] + [(12, "t12", 0)]
    a, b = version(spark, tmp_path, "a", old), version(spark, tmp_path, "b", new, ("n", "id", "text"))
    got = {r["key"]: r["change"] for r in V.changes(spark, a, b, "bigint").collect()}

    def by_key(rows):
        out = {}
        for r in rows:
            out.setdefault(r[0], []).append(r)
        return {k: sorted(v, key=str) for k, v in out.items()}
    x, y = by_key(old), by_key(new)
    want = {k: "added" if k not in x else "removed" if k not in y else "altered"
            for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert got == want and set(want.values()) == {"added", "removed", "altered"} and want[12] == "altered"


def test_only_differing_branches_are_read(spark, tmp_path):
    rows = [(i, f"t{i}", 0) for i in range(2000)]
    a = version(spark, tmp_path, "a", rows)
    same = version(spark, tmp_path, "same", rows[::-1])
    assert V.differing(spark, a, same).count() == 0 and V.changes(spark, a, same, "bigint").count() == 0
    b = version(spark, tmp_path, "b", [(i, "other" if i == 77 else t, n) for i, t, n in rows])
    nodes = V.differing(spark, a, b).collect()
    assert [r["level"] for r in sorted(nodes)] == [0, 1, 2]
    leaf = next(r for r in nodes if r["level"] == V.DEPTH)
    assert leaf["old_keys"] == leaf["new_keys"] < 40 and max(r["old_keys"] for r in nodes) == 2000
    plan = V.changes(spark, a, b, "bigint")
    assert [tuple(r) for r in plan.collect()] == [(77, "altered")]
    files = {f for f in V.index(spark, a, "key bigint, bucket int, slot int").where(
        F.col("slot") == leaf["node"] // V.FANOUT).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) == 1  # one folder of FANOUT sibling buckets


def test_text_boundaries_and_empty_versions(spark, tmp_path):
    a = version(spark, tmp_path, "a", [(1, "1:", 2)])
    b = version(spark, tmp_path, "b", [(1, "1", 2)])
    none = version(spark, tmp_path, "none", [])
    assert [tuple(r) for r in V.changes(spark, a, b, "bigint").collect()] == [(1, "altered")]
    assert [tuple(r) for r in V.changes(spark, none, b, "bigint").collect()] == [(1, "added")]
    assert [tuple(r) for r in V.changes(spark, b, none, "bigint").collect()] == [(1, "removed")]
    assert V.changes(spark, none, none, "bigint").count() == 0
