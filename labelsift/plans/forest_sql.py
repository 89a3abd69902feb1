"""DuckDB oracle SQL for the isolation forest (M1, M2, M5): the same trees as
``labelsift.operators.iforest``, grown level by level in SQL.

Every random draw of the forest is a hash, so SQL can repeat it: the tree
sample ranks ``md5('tree:<seed>:<tree / 2>:<key>')`` (first or second 15 hex
digits by the tree's parity), a node's feature and
threshold come from ``md5('node:<seed>:<tree>:<node>:f|t')``; inputs are the
TF-IDF weights rounded to 9 decimals. Levels are unrolled up to the deepest
possible tree (``ceil(log2 256) = 8``); the depth limit of the data is a
column. Used only by ``oracle_sql()``.
"""

from __future__ import annotations

from labelsift.operators import iforest as IF
from labelsift.operators.tfidf import TfidfConfig
from labelsift.plans.text_sql import term_counts_sql, vocab_sql

MAX_LEVELS = 8  # ceil(log2(256)): the deepest tree any psi <= 256 can grow
_TWO60 = "1152921504606846976.0"


def _h60(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def _c(m: str) -> str:
    """c(m): average unsuccessful-search path length (same operation order as numpy)."""
    return (f"(CASE WHEN {m} > 2 THEN 2.0 * (ln({m} - 1.0) + {IF.EULER_GAMMA!r}) - 2.0 * ({m} - 1.0) / {m} "
            f"WHEN {m} = 2 THEN 1.0 ELSE 0.0 END)")


def _node_u(seed: int, what: str) -> str:
    s = f"'node:{seed}:' || CAST(tree AS VARCHAR) || ':' || CAST(node AS VARCHAR) || ':{what}'"
    return f"({_h60(s)}::DOUBLE / {_TWO60})"


def scores_sql(source: str, cfg: TfidfConfig, key: str = "row_id", text: str = "text",
               trees: int = 200, psi: int = 256, seed: int = 42) -> str:
    """``(key, score)``: forest fitted on every row of ``source`` and applied
    to it, ``score = 2 ** (-E[h] / c(psi))``."""
    if psi > 2 ** MAX_LEVELS:
        raise ValueError("the oracle unrolls trees of psi <= 256")
    tf = "(1.0 + ln(c.tf))" if cfg.sublinear_tf else "CAST(c.tf AS DOUBLE)"
    ctes = [
        f"V AS MATERIALIZED ({vocab_sql(source, cfg, key, text)})",
        f"W AS MATERIALIZED (SELECT k, f, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), {IF.INPUT_DECIMALS}) AS x "
        f"FROM (SELECT c.{key} AS k, v.idx AS f, {tf} * v.idf AS w "
        f"FROM ({term_counts_sql(source, cfg, key, text)}) c JOIN V v USING (term)))",
        f"K AS MATERIALIZED (SELECT {key} AS k FROM ({source}))",
        f"PRM AS MATERIALIZED (SELECT n, psi_e, CAST(ceil(log2(greatest(psi_e, 2))) AS INTEGER) AS md "
        f"FROM (SELECT n, least({psi}, n) AS psi_e FROM (SELECT count(*) AS n FROM K)))",
        f"OFFERS AS MATERIALIZED (SELECT k, tree, ('0x' || substr(md5('tree:{seed}:' || "
        f"CAST(tree // 2 AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1 + 15 * (tree % 2), 15))::BIGINT AS h "
        f"FROM K, (SELECT range AS tree FROM range({trees})))",
        "M0 AS MATERIALIZED (SELECT tree, 0 AS node, k FROM ("
        "SELECT o.tree, o.k, row_number() OVER (PARTITION BY o.tree ORDER BY o.h, o.k) AS rn "
        "FROM OFFERS o), PRM WHERE rn <= PRM.psi_e)",
    ]
    for d in range(MAX_LEVELS + 1):
        ctes += [
            f"S{d} AS MATERIALIZED (SELECT tree, node, count(*) AS m FROM M{d} GROUP BY tree, node)",
            f"CA{d} AS MATERIALIZED (SELECT fs.tree, fs.node, fs.f, "
            f"CASE WHEN fs.cnt < s.m THEN least(fs.mn, 0.0) ELSE fs.mn END AS lo, "
            f"CASE WHEN fs.cnt < s.m THEN greatest(fs.mx, 0.0) ELSE fs.mx END AS hi "
            f"FROM (SELECT mm.tree, mm.node, w.f, count(*) AS cnt, min(w.x) AS mn, max(w.x) AS mx "
            f"FROM M{d} mm JOIN W w ON w.k = mm.k GROUP BY mm.tree, mm.node, w.f) fs "
            f"JOIN S{d} s ON s.tree = fs.tree AND s.node = fs.node, PRM WHERE s.m > 1 AND {d} < PRM.md)",
            f"SP{d} AS MATERIALIZED (SELECT tree, node, f, "
            f"CASE WHEN t > lo AND t < hi THEN t ELSE (lo + hi) / 2.0 END AS t FROM ("
            f"SELECT tree, node, f, lo, hi, lo + {_node_u(seed, 't')} * (hi - lo) AS t FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY f) - 1 AS ci, "
            f"count(*) OVER (PARTITION BY tree, node) AS nc FROM CA{d} WHERE hi > lo) "
            f"WHERE ci = CAST(floor({_node_u(seed, 'f')} * nc) AS BIGINT)))",
            f"LF{d} AS MATERIALIZED (SELECT s.tree, s.node, {d} + {_c('s.m')} AS leaf_value FROM S{d} s "
            f"WHERE NOT EXISTS (SELECT 1 FROM SP{d} sp WHERE sp.tree = s.tree AND sp.node = s.node))",
            f"M{d + 1} AS MATERIALIZED (SELECT mm.tree, CASE WHEN coalesce(w.x, 0.0) < sp.t "
            f"THEN 2 * mm.node + 1 ELSE 2 * mm.node + 2 END AS node, mm.k "
            f"FROM M{d} mm JOIN SP{d} sp ON sp.tree = mm.tree AND sp.node = mm.node "
            f"LEFT JOIN W w ON w.k = mm.k AND w.f = sp.f)",
        ]
    levels = range(MAX_LEVELS + 1)
    ctes += [
        "SPLITS AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, node, f, t FROM SP{d}" for d in levels) + ")",
        "LEAVES AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, node, leaf_value FROM LF{d}"
                                                        for d in levels) + ")",
        f"P0 AS MATERIALIZED (SELECT k, tree, 0 AS node FROM K, (SELECT range AS tree FROM range({trees})))",
    ]
    for d in levels:
        ctes += [
            f"R{d} AS MATERIALIZED (SELECT p.k, p.tree, p.node, sp.f, sp.t FROM P{d} p "
            f"LEFT JOIN SPLITS sp ON sp.tree = p.tree AND sp.node = p.node)",
            f"P{d + 1} AS MATERIALIZED (SELECT r.k, r.tree, CASE WHEN coalesce(w.x, 0.0) < r.t "
            f"THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM R{d} r "
            f"LEFT JOIN W w ON w.k = r.k AND w.f = r.f WHERE r.f IS NOT NULL)",
        ]
    ctes.append("DONE AS (" + " UNION ALL ".join(f"SELECT k, tree, node FROM R{d} WHERE f IS NULL"
                                                 for d in levels) + ")")
    ctes.append("PL AS (SELECT d.k, avg(l.leaf_value) AS e FROM DONE d "
                "JOIN LEAVES l ON l.tree = d.tree AND l.node = d.node GROUP BY d.k)")
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT PL.k AS {key}, power(2.0, -PL.e / {_c('PRM.psi_e')}) AS score FROM PL, PRM")


def flags_sql(scores: str, contamination: str, key: str = "row_id") -> str:
    """M5 + P14 over ``(key, score)``: offset = interpolated ``contamination``
    percentile of ``-score`` (numpy's symmetric lerp), ``anomaly_score =
    score + offset``, flagged iff strictly positive. ``contamination`` is a
    one-row query with column ``c``."""
    return f"""
    WITH s AS ({scores}), cc AS ({contamination}),
    r AS (SELECT -score AS v, row_number() OVER (ORDER BY -score) - 1 AS rk FROM s),
    p AS (SELECT cc.c * (nn.n - 1) AS pos, floor(cc.c * (nn.n - 1)) AS lo, nn.n
          FROM cc, (SELECT count(*) AS n FROM s) nn),
    o AS (SELECT (SELECT v FROM r WHERE rk = p.lo) AS a,
                 (SELECT v FROM r WHERE rk = least(p.lo + 1, p.n - 1)) AS b, p.pos - p.lo AS t FROM p),
    off AS (SELECT CASE WHEN t >= 0.5 THEN b - (b - a) * (1 - t) ELSE a + (b - a) * t END AS off FROM o)
    SELECT s.{key}, s.score, s.score + off.off AS anomaly_score,
           CASE WHEN s.score + off.off > 0 THEN 1 ELSE 0 END AS detector_flag
    FROM s, off"""
