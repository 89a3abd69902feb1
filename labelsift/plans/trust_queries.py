"""Registered queries of source reliability, version provenance and quarantine, and
their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelsift.operators import poison as X
from labelsift.operators import reliability as REL
from labelsift.operators import versions as V
from labelsift.operators.ranks import mid_ranks
from labelsift.plans.common import CORPUS_SQL, RATE, SEED, corpus, docs, hash60_sql, poisoned_sql, r6
from labelsift.session import ensure_checkpoint_dir, stored
from labelsift.sources.corpus import table
from labelsift.streaming.quarantine import quarantine

SIGNALS = ["n_chars", "repeats", "far"]
MARKED = 0.9


def _marks(spark, sf):
    """Every document's source and whether it is in the highest tenth by length, by
    repeated lines and by distance of its length from its source's mean."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    d = docs(spark, sf).select("doc_id", "source", "n_chars", (
        F.size(lines) - F.size(F.array_distinct(lines))).alias("repeats"))
    mean = stored(d.groupBy(F.col("source").alias("of")).agg(F.floor(F.avg("n_chars")).alias("mean")), "means")
    d = stored(d.join(mean, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "n_chars", "repeats", F.abs(F.col("n_chars") - F.col("mean")).alias("far")), "signals")
    ranked = mid_ranks(d, SIGNALS)
    return ranked.select("doc_id", "source", *[(F.col(f"{s}_rank") > MARKED).alias(s) for s in SIGNALS])


def q_source_reliability(spark, sf):
    return r6(REL.reliability(_marks(spark, sf), "source", SIGNALS)[0])


def q_signal_reliability(spark, sf):
    rates = REL.reliability(_marks(spark, sf), "source", SIGNALS)[1]
    return r6(spark.createDataFrame([(r["signal"], r["hit"], r["false_alarm"]) for r in rates],
                                    "signal string, hit double, false_alarm double"))


def _versions(spark, sf):
    """Folders of two committed versions: the labelled corpus, and the corpus after
    poisoning, without its toxic rows and with the documents that have no label."""
    base = corpus(spark, sf).select("row_id", "text", "label")
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"))
    flipped = X.flip_labels(base, "row_id", "label", RATE, SEED).select("row_id", "text", F.col("label").cast("int").alias("label"))
    added = docs(spark, sf).select(F.col("doc_id").alias("row_id"), "text", F.lit(None).cast("int").alias("label")) \
        .join(base.select("row_id"), "row_id", "left_anti")
    after = flipped.join(toxic, "row_id", "left_anti").unionByName(added)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    V.commit(base, "row_id", f"{root}/old")
    V.commit(after, "row_id", f"{root}/new")
    return f"{root}/old", f"{root}/new"


def q_version_changes(spark, sf):
    return V.changes(spark, *_versions(spark, sf), "bigint").select(F.col("key").alias("row_id"), "change")


def q_version_tree(spark, sf):
    """Nodes of each level that differ, with the keys below them: what a
    comparison reads."""
    return V.differing(spark, *_versions(spark, sf)).groupBy("level").agg(
        F.count("*").alias("nodes"), F.sum("old_keys").alias("old_keys"), F.sum("new_keys").alias("new_keys"))


def q_quarantine(spark, sf):
    """Every document is held for an hour from a second of its own on; a labelled one
    is decided after a second a character: toxic ones are dropped."""
    held = docs(spark, sf).select("doc_id", F.timestamp_seconds(F.col("doc_id")).alias("at"), "n_chars")
    answers = held.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.timestamp_seconds(F.col("doc_id") + F.col("n_chars")).alias("decided"),
        (F.col("toxic") == 0).alias("release"))
    judged = quarantine(held.drop("n_chars"), answers, "doc_id", "at", "decided", "release")
    return judged.select("doc_id", "status", (F.unix_seconds("decided_at") - F.unix_seconds("at")).alias("waited"))


QUERIES = {
    "quarantine": q_quarantine,
    "source_reliability": q_source_reliability,
    "signal_reliability": q_signal_reliability,
    "version_changes": q_version_changes,
    "version_tree": q_version_tree,
}

_SHARE = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 1) / (count(*) OVER () - 1)"
_J = range(len(SIGNALS))
_P = REL.PSEUDO


def _like(rate: str) -> str:
    return " * ".join(f"(CASE WHEN s{j} THEN {rate}{j} ELSE 1 - {rate}{j} END)" for j in _J)


_RATES = ", ".join(
    f"(sum(n * post * s{j}::INT) OVER () + {_P * REL.START_HIT!r}) / (sum(n * post) OVER () + {_P!r}) AS a{j}, "
    f"(sum(n * (1 - post) * s{j}::INT) OVER () + {_P * REL.START_FALSE!r}) / (sum(n * (1 - post)) OVER () + {_P!r}) AS b{j}"
    for j in _J)
_EM = f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, list_filter(string_split(coalesce(text, ''), chr(10)),
                          lambda x: trim(x, ' ') <> '') AS l FROM documents),
    s AS (SELECT source, n_chars, len(l) - len(list_distinct(l)) AS repeats,
                 abs(n_chars - floor(avg(n_chars) OVER (PARTITION BY source))) AS far FROM d),
    m AS (SELECT source, {", ".join(f"{_SHARE.format(c=c)} > {MARKED} AS s{j}" for j, c in enumerate(SIGNALS))} FROM s),
    g AS (SELECT source, {", ".join(f"s{j}" for j in _J)}, count(*)::DOUBLE AS n FROM m GROUP BY ALL),
    em AS (
      SELECT 0 AS it, source, n, {", ".join(f"s{j}" for j in _J)},
             {", ".join(f"{REL.START_HIT!r}::DOUBLE AS a{j}" for j in _J)}, {", ".join(f"{REL.START_FALSE!r}::DOUBLE AS b{j}" for j in _J)},
             {REL.START_BAD!r}::DOUBLE AS share, 0.0::DOUBLE AS bad
      FROM g
      UNION ALL
      SELECT it + 1, source, n, {", ".join(f"s{j}" for j in _J)}, {", ".join(f"na{j}" for j in _J)}, {", ".join(f"nb{j}" for j in _J)},
             (total + {_P * REL.START_BAD!r}) / (rows + {_P!r}), total
      FROM (SELECT it, source, n, {", ".join(f"s{j}" for j in _J)},
                   {_RATES.replace(" AS a", " AS na").replace(" AS b", " AS nb")},
                   sum(n * post) OVER (PARTITION BY source) AS total, sum(n) OVER (PARTITION BY source) AS rows
            FROM (SELECT *, share * {_like("a")} / (share * {_like("a")} + (1 - share) * {_like("b")}) AS post FROM em)
            WHERE it < {REL.ROUNDS}))"""

_AFTER = f"""SELECT row_id, text, label FROM ({poisoned_sql(SEED, RATE, CORPUS_SQL)})
             WHERE row_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
             UNION ALL SELECT doc_id, text, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
_CHANGES = f"""SELECT coalesce(o.row_id, n.row_id) AS row_id,
                      CASE WHEN o.row_id IS NULL THEN 'added' WHEN n.row_id IS NULL THEN 'removed' ELSE 'altered' END AS change
               FROM ({CORPUS_SQL}) o FULL JOIN ({_AFTER}) n ON o.row_id = n.row_id
               WHERE o.row_id IS NULL OR n.row_id IS NULL OR o.label IS DISTINCT FROM n.label OR o.text IS DISTINCT FROM n.text"""
_BUCKET = f"({hash60_sql('bucket', 'row_id')} % {V.FANOUT ** V.DEPTH})"

ORACLE = {
    "quarantine": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR d.n_chars NOT BETWEEN 0 AND 3600 OR d.n_chars IS NULL THEN 'expired'
                              WHEN l.toxic = 0 THEN 'released' ELSE 'dropped' END AS status,
               CASE WHEN l.doc_id IS NOT NULL AND d.n_chars BETWEEN 0 AND 3600 THEN d.n_chars END::BIGINT AS waited
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "source_reliability": f"""{_EM}
        SELECT source, sum(n)::BIGINT AS n_rows, round(max(bad), 6) AS expected_bad, round(max(share), 6) AS bad_share,
               round(1 - max(share), 6) AS reliability FROM em WHERE it = {REL.ROUNDS} GROUP BY source""",
    "signal_reliability": f"""{_EM} """ + " UNION ALL ".join(
        f"SELECT '{s}' AS signal, round(max(a{j}), 6) AS hit, round(max(b{j}), 6) AS false_alarm FROM em WHERE it = {REL.ROUNDS}"
        for j, s in enumerate(SIGNALS)),
    "version_changes": _CHANGES,
    "version_tree": f"""
        WITH c AS MATERIALIZED (SELECT {_BUCKET} AS b FROM ({_CHANGES})),
        o AS (SELECT {_BUCKET} AS b FROM ({CORPUS_SQL})), n AS (SELECT {_BUCKET} AS b FROM ({_AFTER})),
        l AS (SELECT range::INT AS level, ({V.FANOUT} ** ({V.DEPTH} - range))::BIGINT AS w FROM range({V.DEPTH + 1})),
        d AS (SELECT DISTINCT level, w, b // w AS node FROM c, l)
        SELECT level, count(*) AS nodes, sum((SELECT count(*) FROM o WHERE o.b // w = node))::BIGINT AS old_keys,
               sum((SELECT count(*) FROM n WHERE n.b // w = node))::BIGINT AS new_keys FROM d GROUP BY level""",
}
