"""Logistic regression objective, binary F1 from counts,
concurrent fits, and the impact experiment on the smoke data."""

import math

import numpy as np

from labelsift.operators import logreg as LR
from labelsift.operators import tfidf as T
from labelsift.plans import experiment as E
from labelsift.session import stored
from tests.conftest import SF001, SF01


def _numpy_logreg(X, y, iters=20000, lr=0.5):
    """Mean log loss + ||w||^2 / (2n) (intercept unpenalised): the
    reference's objective with C = 1, solved by plain gradient descent."""
    n, d = X.shape
    w, b = np.zeros(d), 0.0
    for _ in range(iters):
        p = 1.0 / (1.0 + np.exp(-(X @ w + b)))
        g = X.T @ (p - y) / n + w / n
        gb = float(np.mean(p - y))
        w -= lr * g
        b -= lr * gb
    return w, b


def _frame(spark, X, y):
    rows = []
    for i, (x, t) in enumerate(zip(X, y)):
        nz = np.flatnonzero(x)
        rows.append((i, [int(j) for j in nz], [float(x[j]) for j in nz], float(t)))
    vecs = spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>, label double")
    return LR.model_frame(vecs.drop("label"), vecs.select("row_id", "label"), "row_id", X.shape[1])


def test_objective_matches_numpy(spark):
    rng = np.random.default_rng(7)
    X = rng.random((60, 5)) * (rng.random((60, 5)) < 0.6)
    y = (X[:, 0] + 0.3 * rng.standard_normal(60) > 0.3).astype(float)
    m = LR.fit_logreg(_frame(spark, X, y), len(y), max_iter=1000, tol=1e-10)
    w, b = _numpy_logreg(X, y)
    assert np.allclose(m.coefficients.toArray(), w, atol=2e-3)
    assert abs(m.intercept - b) < 2e-3


def test_gradient_of_the_objective_at_the_shipped_setting(spark):
    """Real TF-IDF features, the tolerance that ships: every entry of the mean
    objective's gradient, the intercept's included, is at most 1e-4."""
    train, _ = E.splits(E.corpus(spark, SF01))
    counted = stored(T.counts(train, "row_id", "text", T.EXPERIMENT, ["label"]))
    n = counted.count()
    vocab = E._vocabulary(counted, "row_id", T.EXPERIMENT, n)
    frame = E._frame(counted, vocab, "row_id", {"label": "label"})
    m = LR.fit_logreg(LR.training_frame(frame), n)
    w, b = m.coefficients.toArray(), m.intercept
    g, gb = w / n, 0.0
    for r in frame.collect():
        z = float(r["features"].dot(w)) + b
        e = (1.0 / (1.0 + math.exp(-z)) - r["label"]) / n
        g[r["features"].indices] += e * r["features"].values
        gb += e
    assert np.abs(g).max() <= 1e-4 and abs(gb) <= 1e-4
    assert m.summary.totalIterations < 1000


def test_binary_f1_not_weighted(spark):
    # predictions fixed by a model that always says 1: F1 of class 1 only
    X = np.array([[1.0], [1.0], [1.0], [1.0]])
    y = np.array([1.0, 1.0, 0.0, 0.0])
    f = _frame(spark, X, y)
    m = LR.fit_logreg(_frame(spark, X, np.array([1.0, 1.0, 1.0, 0.0])), 4, max_iter=100)
    r = LR.evaluate(m, f).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 2, 0, 0)
    assert math.isclose(r["accuracy"], 0.5) and math.isclose(r["f1"], 2 * 2 / (2 * 2 + 2))


def test_fit_concurrently_keeps_order():
    out = LR.fit_concurrently([(lambda a: a * 2, 1), (lambda a: a * 3, 2), (lambda a: a, 5)])
    assert out == [2, 6, 5]


def test_impact_record_on_smoke_data(spark):
    r = E.impact(spark, SF001, max_iter=200).first()
    assert r["config"]["poisoned_samples"] == math.floor(r["config"]["train_samples"] * 0.05)
    for part in ("clean_model", "poisoned_model"):
        assert 0.0 <= r[part]["accuracy"] <= 1.0 and 0.0 <= r[part]["f1"] <= 1.0
    assert math.isclose(r["impact"]["accuracy_drop"],
                        r["clean_model"]["accuracy"] - r["poisoned_model"]["accuracy"])
    assert math.isclose(r["impact"]["f1_drop"], r["clean_model"]["f1"] - r["poisoned_model"]["f1"])
