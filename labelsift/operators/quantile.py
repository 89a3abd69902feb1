"""Exact order statistics without a global sort.

Spark's exact ``percentile`` keeps every distinct value on one reducer and a
global ``orderBy`` + ``row_number`` funnels all rows through one task. Both
break at scale. Here a k-th smallest value is found by histogram refinement:

1. one pass computes count / min / max;
2. each further pass buckets the values of the current range into ``bins``
   equal-width buckets (partial aggregation, so a hot value costs one row per
   partition), a running sum over the <= ``bins`` bucket rows locates the
   bucket holding rank k, and the range shrinks to that bucket's [min, max];
3. once the range holds <= ``exact_limit`` rows (or a single value) the
   remaining rows are ranked with one small window.

A pass reads only one column; callers hand in a materialised single-column
frame. The result is exact: same value as a full sort, and as DuckDB's
``quantile_cont`` / ``row_number`` on the oracle side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 65536
EXACT_LIMIT = 200_000


def _is_integral(dt) -> bool:
    return isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def column_stats(df: DataFrame, col: str) -> tuple:
    """``(n, min, max)`` of the non-null values of ``col`` in one pass."""
    row = df.where(F.col(col).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return row["n"], row["lo"], row["hi"]


def kth_values(df: DataFrame, col: str, ranks, tiebreak: str | None = None,
               bins: int = BINS, exact_limit: int = EXACT_LIMIT, stats: tuple | None = None) -> dict:
    """Return ``{rank: value}`` (0-based ranks, ascending order, nulls ignored).

    With ``tiebreak`` the order is ``(col, tiebreak)`` and each value is a
    ``(col_value, tiebreak_value)`` tuple. ``stats`` may pass a precomputed
    ``column_stats(df, col)`` to save the first pass.
    """
    cols = [F.col(col).alias("v")] + ([F.col(tiebreak).alias("tb")] if tiebreak else [])
    base = df.select(*cols).where(F.col("v").isNotNull())
    integral = _is_integral(base.schema["v"].dataType)
    n, lo0, hi0 = stats if stats is not None else column_stats(base, "v")
    ranks = sorted(set(int(r) for r in ranks))
    if any(r < 0 or r >= n for r in ranks):
        raise ValueError(f"rank out of range for {n} rows: {ranks}")
    out: dict = {}
    _resolve(base, integral, tiebreak is not None, lo0, hi0, 0, n,
             ranks, bins, exact_limit, out)
    return out


def _exact(sub: DataFrame, has_tb: bool, below: int, ranks, out: dict) -> None:
    order = [F.col("v")] + ([F.col("tb")] if has_tb else [])
    w = Window.orderBy(*order)
    got = (sub.withColumn("_r", F.row_number().over(w) - 1 + F.lit(below))
              .where(F.col("_r").isin(ranks)).collect())
    for g in got:
        out[g["_r"]] = (g["v"], g["tb"]) if has_tb else g["v"]


def _resolve(base, integral, has_tb, lo, hi, below, cnt, ranks, bins, limit, out):
    v = F.col("v")
    in_range = base.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
    if lo == hi and not has_tb:
        for r in ranks:
            out[r] = lo
        return
    if cnt <= limit:
        _exact(in_range, has_tb, below, ranks, out)
        return
    if lo == hi:
        # many rows share one value: rank them by the tie-break column instead
        ties = in_range.where(v == F.lit(lo))
        if _is_integral(base.schema["tb"].dataType) or isinstance(
                base.schema["tb"].dataType, (T.DoubleType, T.FloatType)):
            sub = kth_values(ties, "tb", [r - below for r in ranks], bins=bins, exact_limit=limit)
        else:
            sub = kth_strings(ties, "tb", [r - below for r in ranks], cnt, limit)
        for r in ranks:
            out[r] = (lo, sub[r - below])
        return
    if integral:
        width = (int(hi) - int(lo)) // bins + 1
        bucket = F.floor((v - F.lit(lo)) / F.lit(width)).cast("long")
    else:
        span = float(hi) - float(lo)
        bucket = F.least(F.floor((v - F.lit(lo)) / F.lit(span) * F.lit(bins)),
                         F.lit(bins - 1)).cast("long")
    hist = (in_range.groupBy(bucket.alias("b"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax")))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("cum", F.sum("c").over(w) - F.col("c") + F.lit(below))
    hit = None
    for r in ranks:
        cond = (F.col("cum") <= r) & (F.lit(r) < F.col("cum") + F.col("c"))
        hit = cond if hit is None else (hit | cond)
    for b in hist.where(hit).collect():
        mine = [r for r in ranks if b["cum"] <= r < b["cum"] + b["c"]]
        _resolve(base, integral, has_tb, b["bmin"], b["bmax"], b["cum"], b["c"],
                 mine, bins, limit, out)


def kth_strings(df: DataFrame, col: str, ranks, n: int | None = None,
                exact_limit: int = EXACT_LIMIT) -> dict:
    """``{rank: value}`` for 0-based ranks of a string column (binary order,
    nulls ignored), without a global sort.

    Prefix refinement: a pass counts rows per prefix one character longer
    than the current one (partial aggregation); a prefix order is the string
    order, so a running sum over the buckets -- at most one per distinct next
    character -- finds the bucket holding each rank. Only the boundary
    buckets reach the driver, and the search recurses into them until a
    bucket holds <= ``exact_limit`` rows, which one small window ranks.
    """
    base = df.select(F.col(col).alias("s")).where(F.col("s").isNotNull())
    if n is None:
        n = base.count()
    ranks = sorted(set(int(r) for r in ranks))
    if any(r < 0 or r >= n for r in ranks):
        raise ValueError(f"rank out of range for {n} rows: {ranks}")
    out: dict = {}
    _resolve_str(base, "", 0, n, ranks, exact_limit, out)
    return out


def _resolve_str(base, prefix, below, cnt, ranks, limit, out):
    sub = base.where(F.col("s").startswith(F.lit(prefix))) if prefix else base
    if cnt <= limit:
        got = (sub.withColumn("_r", F.row_number().over(Window.orderBy("s")) - 1 + F.lit(below))
                  .where(F.col("_r").isin(ranks)).collect())
        for g in got:
            out[g["_r"]] = g["s"]
        return
    # a string shorter than the new length is its own bucket key; within the
    # prefix that bucket is exactly the prefix itself and sorts first
    hist = sub.groupBy(F.substring("s", 1, len(prefix) + 1).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("cum", F.sum("c").over(w) - F.col("c") + F.lit(below))
    hit = None
    for r in ranks:
        cond = (F.col("cum") <= r) & (F.lit(r) < F.col("cum") + F.col("c"))
        hit = cond if hit is None else (hit | cond)
    for b in hist.where(hit).collect():
        mine = [r for r in ranks if b["cum"] <= r < b["cum"] + b["c"]]
        if b["b"] == prefix:
            for r in mine:
                out[r] = prefix
        else:
            _resolve_str(base, b["b"], b["cum"], b["c"], mine, limit, out)


def exact_percentile(df: DataFrame, col: str, q: float, n: int | None = None) -> float:
    """Linear-interpolated percentile, same definition as numpy's default and
    DuckDB ``quantile_cont``: position ``q*(n-1)`` between two order stats."""
    stats = column_stats(df, col)
    if n is None:
        n = stats[0]
    if n == 0:
        raise ValueError("percentile of an empty column")
    pos = q * (n - 1)
    lo = int(math.floor(pos))
    hi = min(lo + 1, n - 1)
    vals = kth_values(df, col, [lo, hi], stats=stats)
    a, b = float(vals[lo]), float(vals[hi])
    t = pos - lo
    diff = b - a
    # numpy's lerp: symmetric form for t >= 0.5
    return b - diff * (1 - t) if t >= 0.5 else a + diff * t


def top_k(df: DataFrame, col: str, k: int, tiebreak: str, descending: bool = True) -> DataFrame:
    """The first ``k`` rows by ``col`` (descending by default), ties by
    ``tiebreak`` ascending -- as a filter against the exact k-th row.

    Unlike ``orderBy(..).limit(k)`` (every partition ships its top k to a
    single task) the threshold is found by the distributed search above and
    the result stays partitioned. The caller materialises ``df`` when it is
    expensive: the search reads it a few times.
    """
    n = df.count()
    if n <= k:
        return df
    key = (-F.col(col)) if descending else F.col(col)
    probe = df.select(key.alias("_v"), F.col(tiebreak).alias("_tb"))
    v, tb = kth_values(probe, "_v", [k - 1], tiebreak="_tb")[k - 1]
    return df.where((key < F.lit(v)) | ((key == F.lit(v)) & (F.col(tiebreak) <= F.lit(tb))))
