"""Sharding by minimax contiguous partition (operator 11), in DataFrame
functions only.

The atomic units are groups of equal texts, in the order of a digest of their
text, so a group is never cut and the shard of a row is a comparison of its
digest with at most ``shards - 1`` cut digests: no join carries rows to their
groups. The capacity is the smallest one with which a greedy walk over the
ordered group sizes fills no more than the wanted shards; it is found by binary
search, and the walk is cut there.

One check of a capacity is a chain of look-ups "last group border at or before
this position" in the table of borders, which is sorted by position, so that a
look-up reads the row groups around its targets only. ``WAYS`` capacities (four
steps of the binary search) are checked by one chain at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsift.llm.common import keyed_text, prepare, table, written
from labelsift.llm.oracle import CRC_TABLE_SQL, crc32_sql

SHARDS = 8
WAYS = 15
BUCKETS = 4096  # digest ranges within which borders are summed; a fixed number
_LOW_BITS = (1 << 33) - 1


def _borders(groups: DataFrame) -> DataFrame:
    """``(key, border)``: the running sum of ``size`` over the groups in digest
    order, each group included. Digests are uniform, so ranges of their first
    bits hold equal shares of the groups; only the ``BUCKETS`` range totals are
    summed in one place."""
    g = groups.withColumn("bucket", F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int") / (65536 // BUCKETS)) \
        .withColumn("bucket", F.floor("bucket").cast("int"))
    totals = g.groupBy("bucket").agg(F.sum("size").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("bucket").orderBy("key"))
    return g.repartitionByRange("bucket").select("bucket", "key", within.alias("within")) \
        .join(F.broadcast(before), "bucket") \
        .select("key", (F.col("before") + F.col("within")).alias("border")) \
        .sortWithinPartitions("border")


def _advance(borders: DataFrame, at: list[int], caps: list[int], total: int, largest: int) -> list[int]:
    """For each capacity the last border at or before its position plus the
    capacity. A border lies within every ``largest`` bytes."""
    goal = [min(total, a + c) for a, c in zip(at, caps)]
    found = borders.filter(F.col("border").between(min(goal) - largest + 1, max(goal))).agg(
        *[F.max(F.when(F.col("border") <= t, F.col("border"))).alias(f"c{i}") for i, t in enumerate(goal)]).first()
    return [found[i] for i in range(len(goal))]


def _walk(borders: DataFrame, caps: list[int], shards: int, total: int, largest: int) -> list[list[int]]:
    """The greedy walk of every capacity: its first ``shards - 1`` cut positions."""
    at, cuts = [0] * len(caps), []
    for _ in range(shards - 1):
        at = _advance(borders, at, caps, total, largest)
        cuts.append(at)
    return [list(c) for c in zip(*cuts)] if cuts else [[] for _ in caps]


def smallest_capacity(borders: DataFrame, shards: int, total: int, largest: int,
                      ways: int = WAYS) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the cut positions of its greedy walk.
    The mean rounded up plus the largest group is always feasible; neither the
    mean nor the largest group can be undercut."""
    mean = -(-total // shards)
    lo, hi = max(mean, largest), mean + largest
    cuts = None
    while cuts is None or lo < hi:
        if hi - lo <= ways:
            caps = list(range(lo, hi + 1))
        else:
            caps = [lo + (hi - lo) * (i + 1) // (ways + 1) for i in range(ways)] + [hi]
        walks = _walk(borders, caps, shards, total, largest)
        first = next(i for i, (c, w) in enumerate(zip(caps, walks)) if (w[-1] if w else 0) + c >= total)
        hi, cuts = caps[first], walks[first]
        lo = caps[first - 1] + 1 if first else lo
    return hi, cuts


def own_shards(largest: list[tuple[bytes, int]], total: int, shards: int) -> tuple[list[tuple[bytes, int]], int, int]:
    """Groups above the mean of what is left are shards of their own, largest
    first: no partition can fill their shard less, and the others would stay
    behind by as much. Returns them, the rest's total and shard count."""
    own = []
    for key, size in largest:
        if shards < 2 or size * shards <= total:
            break
        own.append((key, size))
        total, shards = total - size, shards - 1
    return own, total, shards


def _between(key: Column, cut_keys: list[bytes], first: int) -> Column:
    out = F.lit(first)
    for k in cut_keys:
        out = out + F.when(key > F.lit(k), 1).otherwise(0)
    return out


def shard_expression(groups: DataFrame, key: Column, shards: int) -> tuple[Column, int]:
    """The shard of a digest, and the capacity: the greatest shard size."""
    top = [(bytes(r["key"]), r["size"]) for r in
           groups.orderBy(F.desc("size"), "key").limit(shards).select("key", "size").collect()]
    if not top:
        return F.lit(0), 0
    total = groups.agg(F.sum("size")).first()[0]
    own, rest, left = own_shards(top, total, shards)
    others = groups.filter(~F.col("key").isin([k for k, _ in own])) if own else groups
    capacity, cut_keys = max([s for _, s in own], default=0), []
    if rest:
        borders = written(_borders(others), "borders")
        largest = top[len(own)][1] if len(own) < len(top) else rest
        fits, cuts = smallest_capacity(borders, left, rest, largest)
        capacity = max(capacity, fits)
        at = {r["border"]: bytes(r["key"]) for r in borders.filter(F.col("border").isin(cuts)).collect()} if cuts else {}
        cut_keys = [at[c] for c in cuts]
    shard = _between(key, cut_keys, 0)
    for i, (k, _) in enumerate(own):
        shard = F.when(key == F.lit(k), left + i).otherwise(shard)
    return shard, capacity


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row: size is the
    text's UTF-8 bytes plus 1, ``shard`` 0 to ``shards - 1``, ``slot`` gapless
    from 0 in each shard by (text digest, id).

    Equal texts share a shard. A group above the mean of the remaining shards is
    a shard of its own (the last numbers, largest first); the others are cut by
    minimax contiguous partition, so the largest shard is as small as it can be.
    With fewer groups than shards the rest are empty. Null texts count as empty
    ones and share their group; null ids sort first; repeated rows get a slot
    each; an empty table gives no rows; other columns, whatever their names, are
    left behind. A text of any length is one value of the JVM (2 GB at most) and
    is read once; only its digest, size and checksum move. The rows of one text
    or one id, however many, are sorted by their place in the input as well, so
    they are dealt over tasks like any others."""
    text = F.col("text")
    rows = written(keyed_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"),
        F.monotonically_increasing_id().alias("place")), "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    shard, _ = shard_expression(groups, F.col("key"), shards)
    order = ["shard", "key", "doc_id", "place"]
    dealt = rows.withColumn("shard", shard.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "shard",
                                 F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit(_LOW_BITS)).alias("i")), "dealt")
    # one row for each task of the sort and shard that it holds: bounded by the cluster
    runs = dealt.groupBy("part", "shard").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    runs = runs.select("part", "shard", (before - F.col("first")).alias("shift"))
    return dealt.join(F.broadcast(runs), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("i") + F.col("shift")).alias("slot"))


def op11_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = f"""
WITH RECURSIVE
CRC AS MATERIALIZED ({CRC_TABLE_SQL}),
D AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, substr(sha256(coalesce(text, '')), 1, 32) AS key,
         {crc32_sql("coalesce(text, '')", "CRC.t")} AS text_crc32 FROM documents, CRC),
G AS MATERIALIZED (SELECT key, sum(size)::BIGINT AS size FROM D GROUP BY key),
TOP AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS rn FROM G QUALIFY rn <= {SHARDS - 1}),
ALONE AS (
  SELECT key, size, rn, size * ({SHARDS} - rn + 1) >
         (SELECT sum(size) FROM G) - coalesce(sum(size) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS above FROM TOP),
OWN AS MATERIALIZED (SELECT key, size, rn FROM ALONE
                     WHERE rn < coalesce((SELECT min(rn) FROM ALONE WHERE NOT above), {SHARDS})),
B AS MATERIALIZED (SELECT key, size, (sum(size) OVER (ORDER BY key))::BIGINT AS border FROM G
                   WHERE key NOT IN (SELECT key FROM OWN)),
P AS MATERIALIZED (
  SELECT list(border) AS borders, max(border) AS total, max(size) AS largest,
         {SHARDS} - (SELECT count(*) FROM OWN) AS k FROM B),
S(lo, hi, cap, pos, step) AS (
  SELECT greatest((total + k - 1) // k, largest), (total + k - 1) // k + largest,
         (greatest((total + k - 1) // k, largest) + (total + k - 1) // k + largest) // 2, 0::BIGINT, 0 FROM P
  UNION ALL
  SELECT lo2, hi2, CASE WHEN ended THEN (lo2 + hi2) // 2 ELSE cap END, CASE WHEN ended THEN 0 ELSE pos2 END,
         CASE WHEN ended THEN 0 ELSE step + 1 END
  FROM (SELECT S.cap, S.step, pos2, step + 1 = P.k AS ended,
               CASE WHEN step + 1 = P.k AND pos2 < P.total THEN cap + 1 ELSE lo END AS lo2,
               CASE WHEN step + 1 = P.k AND pos2 >= P.total THEN cap ELSE hi END AS hi2
        FROM S, P, LATERAL (SELECT list_max(list_filter(P.borders, lambda x: x <= S.pos + S.cap)) AS pos2) WHERE S.lo < S.hi)),
C AS MATERIALIZED (SELECT min(hi) AS cap FROM S),
W(step, pos) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT step + 1, list_max(list_filter(P.borders, lambda x: x <= W.pos + C.cap)) FROM W, P, C WHERE step + 1 < P.k),
CUT AS MATERIALIZED (SELECT B.key FROM W JOIN B ON B.border = W.pos WHERE step > 0),
R AS (
  SELECT D.*, coalesce({SHARDS} - (SELECT count(*) FROM OWN) + OWN.rn - 1,
                       (SELECT count(*) FROM CUT WHERE CUT.key < D.key)) AS shard
  FROM D LEFT JOIN OWN USING (key))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM R
"""
