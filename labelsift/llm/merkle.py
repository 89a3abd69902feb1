"""Merkle dataset manifest by slot pivot (operator 13).

Leaves stand in order; a parent is the run of ``FANOUT`` consecutive nodes.
Conditional aggregates spread a parent's children into slot columns: hashing the
concatenated columns gives the parent, leaving out the own slot gives a child's
siblings. Levels shrink geometrically. Proofs go down the same tables, a parent's
proof reaching its children by one join a level, so all joins together carry half
as many rows as there are leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsift.llm.common import prepare, table, written
from labelsift.llm.oracle import CRC_TABLE_SQL, crc32_sql

FANOUT = 3
_LOW_BITS = (1 << 33) - 1
_PATH = "array<struct<before: string, after: string>>"


def record(values: list[Column]) -> Column:
    """The hashed text of a row: every value as its UTF-8 byte count, ``:`` and
    itself; ``-`` for null. No two rows share it."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes(tree, ...)`` with ``idx``, the row's place in its tree by
    ``order``, and ``n``, the tree's rows. Rows are sorted over all tasks; a
    task's run of a tree is one row of the table that holds the shifts."""
    cols = nodes.columns
    by = ["tree", *order]
    if "place" in cols:
        by.append("place")
    at = F.monotonically_increasing_id()
    laid = written(nodes.repartitionByRange(*by).sortWithinPartitions(*by).select(
        *[c for c in cols if c != "place"], F.shiftright(at, 33).alias("part"),
        at.bitwiseAND(F.lit(_LOW_BITS)).alias("i")), "laid")
    runs = laid.groupBy("tree", "part").agg(F.min("i").alias("first"), F.count("*").alias("m"))
    tree = Window.partitionBy("tree")
    before = F.sum("m").over(tree.orderBy("part")) - F.col("m")
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n"))
    return laid.join(written(runs, "runs"), ["tree", "part"]).select(
        *[c for c in cols if c != "place"], (F.col("i") + F.col("shift")).alias("idx"), "n")


def _raise(nodes: DataFrame, fanout: int) -> DataFrame:
    """The parents of ``nodes(tree, idx, n, node STRUCT<h, ...>)``: ``(tree, idx,
    n, h, c0, c1, ...)`` with the children in slot columns."""
    slot = F.pmod("idx", F.lit(fanout))
    spread = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).cast("bigint").alias("up")).agg(
        *[F.max(F.when(slot == s, F.col("node"))).alias(f"c{s}") for s in range(fanout)], F.max("n").alias("n"))
    joined = F.concat(*[F.coalesce(F.col(f"c{s}.h"), F.lit("")) for s in range(fanout)])
    return spread.select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).cast("bigint").alias("n"),
                         F.sha2(joined, 256).alias("h"), *[f"c{s}" for s in range(fanout)])


def _levels(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels above ``leaves(tree, idx, n, node)``, lowest first, and
    ``(tree, level, h)``, the last node of every tree."""
    ends = [leaves.filter("n = 1").select("tree", F.lit(0).alias("level"), F.col("node.h").alias("h"))]
    highest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while highest > 1:
        up = written(_raise(nodes, fanout), "level")
        levels.append(up)
        ends.append(up.filter("n = 1").select("tree", F.lit(len(levels)).alias("level"), "h"))
        nodes = up.select("tree", "idx", "n", F.struct("h").alias("node"))
        highest = -(-highest // fanout)
    return levels, written(reduce(DataFrame.unionByName, ends), "ends")


def _lower(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``(node, given)`` of every leaf of a tree of two or more: its ``node`` and
    ``given STRUCT<path, ...>`` of its tree's ``tops(tree, level, given)`` with the
    siblings of the leaf's ancestors put before the path, leaf level first."""
    down = None
    for level in range(len(levels), 0, -1):
        start = tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("bigint").alias("idx"), "given")
        here = start if down is None else start.unionByName(down)
        met = levels[level - 1].join(here, ["tree", "idx"])
        kids = []
        for s in range(fanout):
            def side(slots):
                return F.concat(F.lit(""), *[F.coalesce(F.col(f"c{k}.h"), F.lit("")) for k in slots])
            step = F.struct(side(range(s)).alias("before"), side(range(s + 1, fanout)).alias("after"))
            kids.append(F.when(F.col(f"c{s}").isNotNull(), F.struct(
                (F.col("idx") * fanout + s).alias("idx"), F.col(f"c{s}").alias("node"),
                F.concat(F.array(step), F.col("given.path")).alias("path"))))
        down = met.select("tree", "given", F.explode(F.array_compact(F.array(*kids))).alias("k")).select(
            "tree", "k.idx", F.col("k.node").alias("node"), F.col("given").withField("path", F.col("k.path")).alias("given"))
        if level > 1:
            down = down.drop("node")
    return down


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
             fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path, carried columns)`` for every row.

    ``leaf`` is the SHA-256 of the row's ``columns``. The leaves of a group ascend
    by id (null first; equal ids by leaf) and are hashed in runs of ``fanout`` up to
    the ``subroot``; the subroots by group (null first, bytewise) likewise to
    ``root``. ``path`` lists, from the leaf up, the digests before and after the
    node in its run (both empty for a run of one). Null groups are a group of their
    own; repeated rows are a leaf each; an empty table gives no rows; only named
    columns are read, so other names cannot clash. A very long text is one value of
    the JVM (2 GB at most); only digests move. A group, however large, is cut by
    runs, not kept together; groups may be as many as rows."""
    carry = carry or {}
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = written(docs.select(
        tree.alias("tree"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.sha2(record([F.col(f"`{c}`") for c in columns]), 256).alias("leaf"),
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("more"),
        F.monotonically_increasing_id().alias("place")), "leaves")
    placed = _positions(rows, ["doc_id", "leaf"])
    leaves = written(placed.select("tree", "idx", "n", F.struct(
        F.col("leaf").alias("h"), "doc_id", "more").alias("node")), "leaves")
    levels, ends = _levels(leaves, fanout)

    subroots = _positions(ends.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "level", "h"), ["of"])
    subroots = written(subroots.select("tree", "idx", "n", F.struct("h", "of", "level").alias("node")), "subroots")
    crown, top = _levels(subroots, fanout)
    first = top.first()
    root = first["h"] if first else None
    no_path = F.array().cast(_PATH)
    if crown:
        tops = top.select("tree", "level", F.struct(no_path.alias("path")).alias("given"))
        found = _lower(crown, tops, fanout).select("node", F.col("given.path").alias("path"))
    else:
        found = subroots.select("node", no_path.alias("path"))
    tops = written(found.select(F.col("node.of").alias("tree"), F.col("node.level").alias("level"),
                                F.struct("path", F.col("node.h").alias("subroot")).alias("given")), "tops")
    parts = [leaves.filter("n = 1").join(tops, "tree").select("node", "given")]  # groups of one leaf
    if levels:
        parts.append(_lower(levels, tops, fanout).select("node", "given"))
    return reduce(DataFrame.unionByName, parts).select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.h").alias("leaf"), F.col("given.subroot").alias("subroot"),
        F.lit(root).cast("string").alias("root"), F.col("given.path").alias("path"),
        *[F.col(f"node.more.{k}").alias(k) for k in carry])


def proof(path: Column) -> Column:
    """SHA-256 of a path's siblings, leaf level first, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_slot_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    bare = F.translate("text", "\n", "")
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    values = [F.when(hit, bare).otherwise(F.col("text")) if c == "text" else F.col(c) for c in _COLUMNS]
    out = manifest(docs, _COLUMNS, carry={"tampered": F.sha2(record(values), 256)})
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                     folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _record_sql(values: list[str]) -> str:
    return " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v} END"
                       for v in values)


_BARE = "CASE WHEN crc & 1 = 0 THEN replace(text, chr(10), '') ELSE text END"


def _tree_sql(name: str, leaves: str) -> str:
    """``name``: every node of the trees; ``name_K``: siblings of every node."""
    return f"""
{name}(level, tree, idx, n, h) AS (
  SELECT 0, tree, idx, n, h FROM {leaves}
  UNION ALL
  SELECT max(level) + 1, tree, idx // {FANOUT}, max((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, idx // {FANOUT}),
{name}_K AS MATERIALIZED (
  SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.tree = b.tree AND a.idx // {FANOUT} = b.idx // {FANOUT}
  WHERE a.n > 1 GROUP BY ALL)"""


def _climb_sql(name: str, start: str, tree: str) -> str:
    return f"""
{name}(level, tree, idx, r, sibs, f) AS (
  SELECT 0, tree, idx, r, sibs, f FROM {start}
  UNION ALL
  SELECT u.level + 1, u.tree, u.idx // {FANOUT}, r, sibs || before || after, sha256(before || f || after)
  FROM {name} u JOIN {tree}_K k ON k.level = u.level AND k.tree = u.tree AND k.idx = u.idx)"""


OP13_SQL = f"""
WITH RECURSIVE
CRC AS MATERIALIZED ({CRC_TABLE_SQL}),
D AS MATERIALIZED (SELECT *, {crc32_sql("doc_id::VARCHAR", "CRC.t")} AS crc FROM documents, CRC),
H AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_record_sql(_COLUMNS)}) AS h,
         sha256({_record_sql([c if c != "text" else f"({_BARE})" for c in _COLUMNS])}) AS f FROM D),
L AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r FROM H),
{_tree_sql("N", "L")},
SUB AS MATERIALIZED (
  SELECT '' AS tree, tree AS of, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM N WHERE n = 1),
{_tree_sql("T", "SUB")},
{_climb_sql("U", "(SELECT tree, idx, r, '' AS sibs, f FROM L)", "N")},
U1 AS MATERIALIZED (
  SELECT '' AS tree, s.idx, u.r, u.sibs, u.f FROM U u JOIN SUB s ON s.of = u.tree
  WHERE u.level = (SELECT max(level) FROM N WHERE N.tree = u.tree)),
{_climb_sql("V", "U1", "T")}
SELECT L.doc_id, L.h AS leaf, s.h AS subroot, (SELECT h FROM T WHERE n = 1) AS root, sha256(V.sibs) AS proof_sha256,
       V.f AS folded_root, V.f = (SELECT h FROM T WHERE n = 1) AS verified
FROM L JOIN SUB s ON s.of = L.tree JOIN V ON V.r = L.r AND V.level = (SELECT max(level) FROM T)
"""
