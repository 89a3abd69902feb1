"""Connected components of an edge table by alternating star steps.

Each step is one aggregation (least neighbour of a node, combined map-side)
and one join on the node, whose aggregated side is written first (a join splits
a hot node only where its other side is no aggregation); a component of any size shrinks to a star around
its least node in a logarithmic number of steps. No edge or component is ever
collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: every neighbour above a node is linked to the
    least of the node and its neighbours. Small: the same among the neighbours
    below it, and the node itself."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("m")), "least")
        out = pairs.filter("v > u").join(least, "u").select("v", "m")
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = pairs.join(least, "u").select("v", "m") \
            .unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a BIGINT, b BIGINT)`` -> ``(node, root)`` for every node of an
    edge, ``root`` being the least node of its component (itself included).
    Self-loops and repeated edges are allowed; an empty table gives none."""
    cur = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(cur)
    while mark[0]:
        cur = written(_star(_star(cur, large=True), large=False), "edges")
        new = _mark(cur)
        if new == mark:
            break
        mark = new
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
