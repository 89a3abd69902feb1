"""DuckDB oracle SQL for the logistic-regression experiments.

The objective is the model's own: summed log loss plus ||w||^2 / 2, intercept
unpenalised. Its weights are a combination of the training rows, so SQL iterates
one coefficient a row and the intercept over the rows' kernel matrix: full-batch
gradient steps with Nesterov momentum in a recursive CTE, run far past
convergence. Used only by ``oracle_sql()`` on the small correctness tables.
"""

from __future__ import annotations

from labelsift.operators.tfidf import TfidfConfig
from labelsift.plans.text_sql import tfidf_sql

STEPS = 500


def margins_sql(train: str, test: str, cfg: TfidfConfig, weight: str = "1.0::DOUBLE") -> str:
    """``(row_id, y, z, intercept, n_train)`` for the rows of ``test``: the margin of the
    model fitted on ``train`` (``row_id, text, label``); ``weight`` is a training row's
    weight, an expression over its columns."""
    return f"""
    WITH RECURSIVE
    W AS MATERIALIZED ({tfidf_sql(train, cfg)}),
    WT AS MATERIALIZED ({tfidf_sql(train, cfg, test)}),
    TR AS MATERIALIZED (SELECT row_id AS i, CAST(label AS DOUBLE) AS y, {weight} AS wt FROM ({train})),
    DOTS AS MATERIALIZED (SELECT p.row_id AS i, q.row_id AS j, sum(p.weight * q.weight) AS k
                          FROM W p JOIN W q USING (term) GROUP BY 1, 2),
    KM AS MATERIALIZED (SELECT p.i, q.i AS j, coalesce(d.k, 0.0) AS k
                        FROM TR p CROSS JOIN TR q LEFT JOIN DOTS d ON d.i = p.i AND d.j = q.i),
    PRM AS MATERIALIZED (SELECT big, (sqrt(big) - 1) / (sqrt(big) + 1) AS m FROM (
        SELECT 1 + ((SELECT max(r) FROM (SELECT sum(k * wt) AS r FROM KM JOIN TR ON TR.i = KM.j GROUP BY KM.i))
                    + sum(wt)) / 4 AS big FROM TR)),
    S(it, i, a, ap, b, bp) AS (
        SELECT 0, i, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM TR
        UNION ALL
        SELECT it + 1, i, va - (va - wt * (y - 1 / (1 + exp(-z)))) / big, a,
               vb - sum(wt * (1 / (1 + exp(-z)) - y)) OVER () / big, b
        FROM (SELECT max(s.it) AS it, KM.i, max(CASE WHEN KM.j = KM.i THEN s.a END) AS a, max(s.b) AS b,
                     max(CASE WHEN KM.j = KM.i THEN s.a + PRM.m * (s.a - s.ap) END) AS va,
                     max(s.b + PRM.m * (s.b - s.bp)) AS vb,
                     sum(KM.k * (s.a + PRM.m * (s.a - s.ap))) + max(s.b + PRM.m * (s.b - s.bp)) AS z,
                     max(PRM.big) AS big
              FROM S s JOIN KM ON KM.j = s.i, PRM WHERE s.it < {STEPS} GROUP BY KM.i) n
             JOIN TR USING (i)),
    FIT AS MATERIALIZED (SELECT i, a, b FROM S WHERE it = {STEPS}),
    MARGIN AS (SELECT t.row_id, sum(t.weight * w.weight * f.a) AS z
               FROM WT t JOIN W w USING (term) JOIN FIT f ON f.i = w.row_id GROUP BY t.row_id)
    SELECT row_id, s.label AS y, coalesce(m.mz, 0.0) + (SELECT max(b) FROM FIT) AS z,
           (SELECT max(b) FROM FIT) AS intercept, (SELECT count(*) FROM TR) AS n_train
    FROM ({test}) s LEFT JOIN (SELECT row_id, z AS mz FROM MARGIN) m USING (row_id)"""


def confusion_sql(train: str, test: str, cfg: TfidfConfig, weight: str = "1.0::DOUBLE") -> str:
    """``(intercept, mean_probability, n_train, n_test, tp, fp, fn, tn)`` of the model fitted on ``train``
    (``row_id, text, label``) and applied to ``test``."""
    return f"""
    SELECT max(intercept) AS intercept, avg(1 / (1 + exp(-z))) AS mean_probability, max(n_train) AS n_train, count(*) AS n_test,
           count(*) FILTER (WHERE y = 1 AND z > 0) AS tp, count(*) FILTER (WHERE y = 0 AND z > 0) AS fp,
           count(*) FILTER (WHERE y = 1 AND z <= 0) AS fn, count(*) FILTER (WHERE y = 0 AND z <= 0) AS tn
    FROM ({margins_sql(train, test, cfg, weight)})"""


def scores_of(confusion: str) -> str:
    """``(n_train, n_test, accuracy, f1)`` from the counts."""
    return (f"SELECT n_train, n_test, coalesce((tp + tn) / nullif(n_test, 0), 0.0) AS accuracy, "
            f"coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM ({confusion})")
