"""Mixing: classifier accuracy on rows it has not seen, rates against a plain
solver, targets met, edge cases."""

import numpy as np
import pytest

from labelsift.llm import mixing
from labelsift.llm.common import table, written
from tests.conftest import SF01
from tests.llm.data import docs, edge_rows

SF1 = "/root/testdata/sf0.1"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, domain string")


def test_classifier_on_unseen_rows(spark):
    d, lab = table(spark, SF1, "documents"), mixing.quality_domains(spark, SF1)
    seen = lab.filter("doc_id % 2 = 0")
    rated = {r.doc_id: r for r in mixing.mix(d, seen).collect()}
    unseen = lab.filter("doc_id % 2 = 1").collect()
    assert sum(rated[r.doc_id].domain == r.domain for r in unseen) / len(unseen) >= 0.95


def test_targets_are_met(spark):
    rated = mixing.mix(table(spark, SF01, "documents"), mixing.quality_domains(spark, SF01)).collect()
    total = {n: sum(r.rate * r.tokens * r.p[n] for r in rated) for n in mixing.TARGETS}
    whole = sum(total.values())
    for n, share in mixing.TARGETS.items():
        assert total[n] / whole == pytest.approx(share, abs=2e-4)
    assert min(r.rate for r in rated) >= 0
    for r in rated:
        assert sum(r.p.values()) == pytest.approx(1.0)


def plain_rates(t, p, target, steps=20_000):
    """Projected gradient with a small fixed step on the plain objective."""
    r = np.ones(len(t))
    eta = 1.0 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    for _ in range(steps):
        r = np.maximum(0.0, r - eta * p @ ((r * t) @ p - target))
    return r


@pytest.mark.parametrize("target", [(0.5, 0.3, 0.2), (0.7, 0.29, 0.01), (0.98, 0.01, 0.01)])
def test_rates_match_a_plain_solver(spark, target):
    rng = np.random.default_rng(3)
    t = rng.integers(5, 400, 300)
    p = rng.dirichlet((0.3, 0.3, 0.3), 300)
    want = np.array(target) * t.sum()
    rows = written(spark.createDataFrame(
        [(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))],
        "doc_id bigint, tokens bigint, p array<double>"))
    rated, steps, error = mixing.fit_rates(rows, want)
    r = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
    plain = plain_rates(t.astype(float), p, want)
    assert r.min() >= 0 and steps < mixing.MAX_STEPS
    have, best = (r * t) @ p, (plain * t) @ p
    assert np.abs(have - want).sum() <= np.abs(best - want).sum() + 1e-4 * t.sum()


def test_moves_are_replayed_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = written(spark.createDataFrame(
        [(i, int(rng.integers(1, 50)), [float(x) for x in rng.dirichlet((0.2, 0.2))]) for i in range(50)],
        "doc_id bigint, tokens bigint, p array<double>"))
    want = np.array([900.0, 20.0])
    a = [r.rate for r in mixing.fit_rates(rows, want)[0].orderBy("doc_id").collect()]
    monkeypatch.setattr(mixing, "REWRITE", 1)
    b = [r.rate for r in mixing.fit_rates(rows, want)[0].orderBy("doc_id").collect()]
    assert a == pytest.approx(b)


def test_edge_rows_without_and_with_labels(spark):
    rows = edge_rows()
    df = docs(spark, rows, clash=True)
    none = mixing.mix(df, labelled(spark, [])).collect()
    assert len(none) == len(rows) and {r.rate for r in none} == {1.0} and {r.domain for r in none} == {None}
    assert {r.doc_id: r.tokens for r in none}[3] == 0
    lab = labelled(spark, [(4, "high"), (4, "high"), (6, "high"), (8, "low"), (None, "low"), (9, None),
                           (999, "toxic"), (10, "low")])
    got = mixing.mix(df, lab).collect()
    assert len(got) == len(rows) and {r.domain for r in got} <= {"high", "low"}
    assert all(r.rate >= 0 for r in got)
    assert mixing.mix(df.limit(0), lab).count() == 0
    one = mixing.mix(df, labelled(spark, [(4, "high")])).collect()
    assert {r.rate for r in one} == {1.0} and {r.domain for r in one} == {"high"}


def test_stage_repeats_and_drops_by_rate(spark):
    d, lab = table(spark, SF01, "documents"), mixing.quality_domains(spark, SF01)
    rated = {r.doc_id: r for r in mixing.mix(d, lab).collect()}
    out = mixing.repeat_by_rate(d, lab)
    assert out.columns == d.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for k, r in rated.items():
        n = times.get(k, 0)
        assert int(r.rate) <= n <= int(r.rate) + 1 or (n == 1 and r.domain not in mixing.REDUCED)
        assert n or r.domain in mixing.REDUCED
    edge = docs(spark, edge_rows(), clash=True)
    same = mixing.repeat_by_rate(edge, labelled(spark, []))
    assert same.count() == edge.count() and same.columns == edge.columns


def test_no_document_but_toxic_ones_can_go(spark):
    # plenty of low-quality tokens for each high-quality one: still none vanishes
    d, lab = table(spark, SF01, "documents"), mixing.quality_domains(spark, SF01)
    rated = written(mixing.mix(d, lab).select("doc_id", "domain"))
    some = d.join(rated.filter("domain != 'high' or doc_id % 8 = 0").select("doc_id"), "doc_id", "left_semi")
    again = {r.doc_id: r.domain for r in mixing.mix(some, lab).collect()}
    out = {r.doc_id for r in mixing.repeat_by_rate(some, lab).select("doc_id").collect()}
    assert sum(x == "low" for x in again.values()) > 0
    assert {k for k, x in again.items() if x != "toxic"} <= out
