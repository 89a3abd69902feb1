"""Isolation forest on sparse TF-IDF rows (M1, M2, P14; Liu, Ting & Zhou 2008).

Fit (M1), tree-parallel:

1. every row draws one hash per tree (two draws per md5 digest); a tree keeps
   the ``psi`` smallest draws -- a uniform sample without replacement per tree,
   by one rule at every table size. Only draws under a threshold that leaves
   about three times the sample are ranked (``row_number`` inside ``partition
   by tree``); if a tree comes out short the threshold is raised;
2. the selected ``(tree, key)`` list (at most ``trees * psi`` rows, a proven
   bound) is checkpointed and broadcast into the vector table, and
   ``groupBy(tree).applyInPandas`` grows each tree in numpy on its rows.

Split rule: feature uniform over the features not constant in the node,
threshold uniform in (min, max); depth limit ``ceil(log2 psi)``; a leaf of
``m`` rows adds ``c(m)``. Every random draw is a hash: the sample uses
``md5('tree:<seed>:<tree / 2>:<key>')`` (first or second 15 hex digits by the
tree's parity), a node's feature and threshold use
``md5('node:<seed>:<tree>:<node>:f|t')`` with level-order node ids (children
of ``i`` are ``2i+1``, ``2i+2``). Inputs are rounded to 9 decimals, so a
split never hinges on the last bits of a weight (summation order). The forest
is therefore independent of partitioning and engine: the oracle grows the
same trees in SQL.

Score (M2): the forest (<= trees * (2**(depth+1) - 1) nodes) is broadcast
and ``mapInArrow`` walks all trees level by level for a whole Arrow batch;
``score = 2 ** (-E[h] / c(psi))``. Flags and the shifted anomaly score come
from the exact contamination percentile (operators.metrics).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.session import materialize, ship_package

EULER_GAMMA = 0.5772156649015329
TREE_OVERSAMPLE = 3
TWO60 = float(1 << 60)
INPUT_DECIMALS = 9


def c_factor(m):
    """Average path length of an unsuccessful BST search over ``m`` rows."""
    m = np.asarray(m, dtype=np.float64)
    out = np.zeros_like(m)
    two = m == 2
    big = m > 2
    out[two] = 1.0
    mb = m[big]
    out[big] = 2.0 * (np.log(mb - 1.0) + EULER_GAMMA) - 2.0 * (mb - 1.0) / mb
    return out


@dataclass
class Forest:
    """Fitted forest as padded node arrays, shape ``(trees, max_nodes)``."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_value: np.ndarray  # depth + c(size) at leaves, NaN at internal nodes
    psi: int
    max_depth: int
    lookup: np.ndarray | None = None  # original feature -> compact column, -1 if unused
    width: int = 0

    def compact(self, n_features: int) -> "Forest":
        """Renumber split features to the columns the forest actually uses, so
        scoring densifies ``rows x used`` instead of ``rows x vocabulary``."""
        used = np.unique(self.feature[self.feature >= 0])
        lookup = np.full(max(n_features, 1), -1, dtype=np.int64)
        lookup[used] = np.arange(used.size)
        feature = np.where(self.feature >= 0, lookup[np.maximum(self.feature, 0)], -1)
        return Forest(feature, self.threshold, self.left, self.right, self.leaf_value,
                      self.psi, self.max_depth, lookup, int(max(used.size, 1)))

    @property
    def n_trees(self) -> int:
        return self.feature.shape[0]


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, "
               "right int, leaf_value double")


def node_uniform(seed: int, tree: int, node: int, what: str) -> float:
    """Uniform [0, 1) draw of a node: ``md5('node:<seed>:<tree>:<node>:<what>')``
    (first 15 hex digits) / 2**60 -- the same value as the oracle's SQL."""
    h = int(hashlib.md5(f"node:{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:15], 16)
    return float(h) / TWO60


def rounded_inputs(vecs: DataFrame) -> DataFrame:
    """Forest inputs: sparse values rounded to ``INPUT_DECIMALS`` places."""
    return vecs.withColumn("values", F.transform("values", lambda v: F.round(v, INPUT_DECIMALS)))


def tree_offers(keys: DataFrame, key: str, trees: int, seed: int, below: int | None = None) -> DataFrame:
    """``(key, tree, _h)``: the 60-bit draw of every key for every tree, those
    under ``below`` only. One md5 digest holds the draws of two trees."""
    pairs = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // 2))).alias("_pair")
    digest = F.md5(F.concat(F.lit(f"tree:{seed}:"), F.col("_pair").cast("string"), F.lit(":"),
                            F.col(key).cast("string")))
    d = keys.select(key, pairs).withColumn("_d", digest)

    def draw(first: int):
        return F.conv(F.substring("_d", first, 15), 16, 10).cast("bigint")

    both = d.select(key, F.explode(F.array(
        F.struct((2 * F.col("_pair")).alias("tree"), draw(1).alias("_h")),
        F.struct((2 * F.col("_pair") + 1).alias("tree"), draw(16).alias("_h")))).alias("_o"))
    out = both.select(key, "_o.tree", "_o._h").where(F.col("tree") < trees)
    return out if below is None else out.where(F.col("_h") < F.lit(below))


def sample_trees(vecs: DataFrame, key: str, n: int, trees: int = 200, psi: int = 256,
                 seed: int = 42) -> DataFrame:
    """``(tree, key)`` of every tree's sub-sample, checkpointed: exactly
    ``min(psi, n)`` rows a tree."""
    psi = min(psi, n)
    w = Window.partitionBy("tree").orderBy("_h", key)
    q = TREE_OVERSAMPLE * psi / n
    while True:
        offers = tree_offers(vecs.select(key), key, trees, seed, int(q * TWO60) if q < 1.0 else None)
        chosen = materialize(offers.withColumn("_r", F.row_number().over(w))
                             .where(F.col("_r") <= psi).select("tree", key))
        if q >= 1.0 or chosen.count() == trees * psi:
            return chosen
        q *= 4.0


def _grow(rows: pd.DataFrame, n_features: int, psi: int, max_depth: int, seed: int) -> pd.DataFrame:
    tree = int(rows["tree"].iloc[0])
    m = len(rows)
    # dense only over the features present in the sample (sorted, so candidate
    # order is the feature order): an absent feature is constant 0 and can
    # never be split on, so the block is psi x (sample terms), not x vocabulary
    parts = [np.asarray(ind, dtype=np.int64) for ind in rows["indices"] if ind is not None and len(ind)]
    present = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
    X = np.zeros((m, max(present.size, 1)), dtype=np.float64)
    for i, (ind, val) in enumerate(zip(rows["indices"], rows["values"])):
        if ind is not None and len(ind):
            X[i, np.searchsorted(present, np.asarray(ind, dtype=np.int64))] = np.asarray(val, dtype=np.float64)
    width = 2 ** (max_depth + 1) - 1
    feat = np.full(width, -1, dtype=np.int32)
    thr = np.full(width, np.nan)
    leaf = np.full(width, np.nan)
    used = np.zeros(width, dtype=bool)
    stack = [(np.arange(m), 0, 0)]
    while stack:
        idx, depth, node = stack.pop()
        used[node] = True
        size = len(idx)
        if depth >= max_depth or size <= 1:
            leaf[node] = depth + float(c_factor([size])[0])
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            leaf[node] = depth + float(c_factor([size])[0])
            continue
        f = int(cand[int(math.floor(node_uniform(seed, tree, node, "f") * cand.size))])
        t = lo[f] + node_uniform(seed, tree, node, "t") * (hi[f] - lo[f])
        if not (lo[f] < t < hi[f]):
            t = (lo[f] + hi[f]) / 2.0
        feat[node], thr[node] = present[f], t
        go_left = sub[:, f] < t
        stack.append((idx[~go_left], depth + 1, 2 * node + 2))
        stack.append((idx[go_left], depth + 1, 2 * node + 1))
    nodes = np.flatnonzero(used)
    internal = feat[nodes] >= 0
    return pd.DataFrame({"tree": np.full(nodes.size, tree, dtype=np.int32), "node": nodes.astype(np.int32),
                         "feature": feat[nodes], "threshold": thr[nodes],
                         "left": np.where(internal, 2 * nodes + 1, -1).astype(np.int32),
                         "right": np.where(internal, 2 * nodes + 2, -1).astype(np.int32),
                         "leaf_value": leaf[nodes]})


def fit_nodes(vecs: DataFrame, key: str, n_features: int, n: int | None = None,
              trees: int = 200, psi: int = 256, seed: int = 42, keys: DataFrame | None = None,
              vectors_of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int, int]:
    """M1: the forest as a node table (lazy). Returns ``(nodes, psi, max_depth)``.

    Where ``vecs`` is a map over a table, every use computes it whole: pass the
    table's ``keys`` to draw from, and ``vectors_of(chosen keys)`` to compute the
    vectors of the sampled rows alone."""
    n = int(n if n is not None else vecs.count())
    if n == 0:
        raise ValueError("cannot fit an isolation forest on an empty table")
    psi = min(psi, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    ship_package(vecs.sparkSession)  # the tree builder runs in Python workers
    chosen = sample_trees(vecs if keys is None else keys, key, n, trees, psi, seed)
    if vectors_of is not None:
        vecs = vectors_of(chosen.select(key).distinct())
    # round after the join: only the <= trees * psi sampled rows need it
    rows = rounded_inputs(vecs.join(F.broadcast(chosen), key).select("tree", key, "indices", "values"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        return _grow(pdf, n_features, psi, max_depth, seed)

    nodes = rows.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return nodes, psi, max_depth


def collect_forest(nodes: DataFrame, psi: int, max_depth: int) -> Forest:
    """Bring the node table to the driver for broadcasting; its size is bounded
    by ``trees * (2 ** (max_depth + 1) - 1)`` rows, independent of the data."""
    pdf = nodes.toPandas()
    trees = int(pdf["tree"].max()) + 1
    width = int(pdf["node"].max()) + 1
    shape = (trees, width)
    feature = np.full(shape, -1, dtype=np.int64)
    threshold = np.zeros(shape)
    left = np.zeros(shape, dtype=np.int64)
    right = np.zeros(shape, dtype=np.int64)
    leaf_value = np.full(shape, np.nan)
    t, nd = pdf["tree"].to_numpy(), pdf["node"].to_numpy()
    feature[t, nd] = pdf["feature"].to_numpy()
    threshold[t, nd] = np.nan_to_num(pdf["threshold"].to_numpy())
    left[t, nd] = np.maximum(pdf["left"].to_numpy(), 0)
    right[t, nd] = np.maximum(pdf["right"].to_numpy(), 0)
    leaf_value[t, nd] = pdf["leaf_value"].to_numpy()
    return Forest(feature, threshold, left, right, leaf_value, psi, max_depth)


def path_lengths(forest: Forest, X: np.ndarray) -> np.ndarray:
    """Mean path length per row of dense ``X`` over all trees (vectorised)."""
    m, n = X.shape[0], forest.n_trees
    node = np.zeros((m, n), dtype=np.int64)
    tree_ix = np.broadcast_to(np.arange(n), (m, n))
    rows = np.broadcast_to(np.arange(m)[:, None], (m, n))
    for _ in range(forest.max_depth + 1):
        f = forest.feature[tree_ix, node]
        internal = f >= 0
        if not internal.any():
            break
        x = X[rows, np.where(internal, f, 0)]
        go_left = x < forest.threshold[tree_ix, node]
        nxt = np.where(go_left, forest.left[tree_ix, node], forest.right[tree_ix, node])
        node = np.where(internal, nxt, node)
    return forest.leaf_value[tree_ix, node].mean(axis=1)


SCORE_CHUNK_BYTES = 16 << 20  # of each of some six arrays


def densify(offsets: np.ndarray, flat_i: np.ndarray, flat_v: np.ndarray, lookup: np.ndarray,
            width: int) -> np.ndarray:
    """Dense ``rows x width`` block of the rows between ``offsets``, keeping
    only features with a compact column in ``lookup``."""
    m = len(offsets) - 1
    X = np.zeros((m, width))
    part = slice(int(offsets[0]), int(offsets[-1]))
    col = lookup[flat_i[part]]
    keep = col >= 0
    rows = np.repeat(np.arange(m), np.diff(offsets))
    X[rows[keep], col[keep]] = flat_v[part][keep]
    return X


def score_rows(forest: Forest, offsets: np.ndarray, flat_i: np.ndarray, flat_v: np.ndarray) -> np.ndarray:
    """Scores for a batch of sparse rows, in chunks of bounded dense size."""
    m = len(offsets) - 1
    out = np.empty(m)
    step = max(1, SCORE_CHUNK_BYTES // (8 * max(forest.width, forest.n_trees)))
    cpsi = float(c_factor([forest.psi])[0])
    for a in range(0, m, step):
        X = densify(offsets[a:min(a + step, m) + 1], flat_i, flat_v, forest.lookup, forest.width)
        out[a:a + step] = np.power(2.0, -path_lengths(forest, X) / cpsi)
    return out


def score(vecs: DataFrame, key: str, forest: Forest, n_features: int,
          out: str = "score", carry: tuple = ()) -> DataFrame:
    """M2: ``(key, *carry, score)`` with ``score`` in (0, 1), higher = more
    isolated; a map over the rows, so carried columns need no join."""
    sc = vecs.sparkSession.sparkContext
    ship_package(vecs.sparkSession)  # the scorer runs in Python workers
    if forest.lookup is None:
        forest = forest.compact(n_features)
    bc = sc.broadcast(forest)
    cols = [key, *[c for c in carry if c != key]]

    def run(batches):
        f = bc.value
        for b in batches:
            ind, val = b.column("indices"), b.column("values")
            off = np.asarray(ind.offsets)
            s = score_rows(f, off - off[0], ind.flatten().to_numpy(zero_copy_only=False),
                           val.flatten().to_numpy(zero_copy_only=False)) if b.num_rows else np.empty(0)
            yield pa.record_batch([b.column(c) for c in cols] + [pa.array(s)], names=[*cols, out])

    schema = T.StructType([vecs.schema[c] for c in cols]).add(out, "double")
    return rounded_inputs(vecs.select(*cols, "indices", "values")).mapInArrow(run, schema)
