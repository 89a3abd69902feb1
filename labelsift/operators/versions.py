"""Provenance of a table's versions: a hash tree over key buckets.

``commit`` stores for a version one digest a row (no columns) and a hash tree over
the buckets; ``FANOUT`` sibling buckets share a folder, sorted by bucket.
``changes`` compares two versions from the root down: only children of nodes that
differ are looked at, and only folders that hold a differing bucket are read (and
of those, by the files' statistics, the parts near one). The tables themselves are
not read again.

A bucket is a hash of the key, so a hot value of another column cannot fill one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.functions.columns import hash60

FANOUT = 16
NODE = "node int, n_keys bigint, digest string"
DEPTH = 2  # FANOUT ** DEPTH buckets; take 4 for tables of billions of rows


def row_digest(cols: list[str]) -> Column:
    """60-bit digest of a row: every column as ``<length>:<value>``, null as ``-``."""
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (F.col(f"`{c}`").cast("string") for c in cols)]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")


def bucket_of(key: str, depth: int = DEPTH) -> Column:
    """A null key is in bucket 0."""
    return F.coalesce(F.pmod(hash60("bucket", key), F.lit(FANOUT ** depth)), F.lit(0)).cast("int")


def slot_of(bucket: str) -> Column:
    return F.floor(F.col(bucket) / FANOUT).cast("int")


def commit(df: DataFrame, key: str, path: str, depth: int = DEPTH) -> None:
    """Write the version's index (``rows/slot=…``: key, copies, digest, bucket) and its
    tree (``nodes/level=…``: level ``depth`` the buckets, level 0 the root).

    Rows that share a key are one entry: their number and the sum of their digests,
    which no order of rows can change. The order of columns does not count."""
    cols = sorted(df.columns)
    rows = df.select(F.col(f"`{key}`").alias("key"), row_digest(cols).alias("digest"))
    rows = rows.groupBy("key").agg(F.count("*").alias("copies"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest"))
    rows = rows.withColumn("bucket", bucket_of("key", depth))
    rows = rows.withColumn("slot", slot_of("bucket"))
    rows.repartition("slot").sortWithinPartitions("slot", "bucket", "key").write.partitionBy("slot").parquet(f"{path}/rows")
    spark = df.sparkSession
    stored = index(spark, path, rows.schema)
    entry = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("-")), "copies", "digest")),
                               1, 15), 16, 10).cast("decimal(38,0)")
    node = stored.groupBy(F.col("bucket").alias("node")).agg(
        F.sum(entry).alias("s"), F.count("*").alias("n_keys")).select(
        "node", "n_keys", F.md5(F.concat_ws(":", "n_keys", "s")).alias("digest"))
    for level in range(depth, -1, -1):
        at = f"{path}/nodes/level={level}"
        node.write.parquet(at)
        below = spark.read.schema(NODE).parquet(at)
        child = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT at most
        node = below.groupBy((F.floor(F.col("node") / FANOUT)).cast("int").alias("parent")).agg(
            F.sum("n_keys").alias("n_keys"), child.alias("c")).select(
            F.col("parent").alias("node"), "n_keys",
            F.md5(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["digest"])), ",")).alias("digest"))


def index(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows")


def differing(spark: SparkSession, old: str, new: str, depth: int = DEPTH) -> DataFrame:
    """``(level, node, old_keys, new_keys)`` of every node that differs, found from
    the root down; a level is read only below nodes that differ."""
    found, above = None, None
    for level in range(depth + 1):
        def side(path, name):
            nodes = spark.read.schema(NODE).parquet(f"{path}/nodes/level={level}")
            if above is not None:
                nodes = nodes.where(F.floor(F.col("node") / FANOUT).isin(above))
            return nodes.select("node", F.col("n_keys").alias(f"{name}_keys"), F.col("digest").alias(f"{name}_digest"))
        both = side(old, "old").join(side(new, "new"), "node", "full").where(
            ~F.col("old_digest").eqNullSafe(F.col("new_digest"))).select(
            F.lit(level).alias("level"), "node", F.coalesce("old_keys", F.lit(0)).alias("old_keys"),
            F.coalesce("new_keys", F.lit(0)).alias("new_keys"))
        found = both if found is None else found.unionByName(both)
        above = [r["node"] for r in both.select("node").collect()]  # FANOUT ** depth at most
        if not above:
            break
    return found


def changes(spark: SparkSession, old: str, new: str, schema, depth: int = DEPTH) -> DataFrame:
    """``(key, change)`` with change added, removed or altered. ``schema`` is that
    of the key. Both sides meet in one aggregation by key (null is a key); only
    folders of differing buckets are listed and read."""
    buckets = [r["node"] for r in differing(spark, old, new, depth).where(F.col("level") == depth).select("node").collect()]
    slots = sorted({b // FANOUT for b in buckets})
    full = f"key {schema}, copies bigint, digest decimal(38,0), bucket int, slot int"

    def side(path, sign):
        rows = index(spark, path, full)
        rows = rows.where(F.col("slot").isin(slots) & F.col("bucket").isin(buckets)) if buckets else rows.limit(0)
        return rows.select("key", *[(F.col(c) if s == sign else F.lit(None).cast(t)).alias(f"{s}_{c}")
                                    for s in ("old", "new") for c, t in (("copies", "bigint"), ("digest", "decimal(38,0)"))])
    both = side(old, "old").unionByName(side(new, "new")).groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("old_copies", "old_digest", "new_copies", "new_digest")])
    same = (F.col("old_copies") == F.col("new_copies")) & (F.col("old_digest") == F.col("new_digest"))
    change = F.when(F.col("old_copies").isNull(), "added").when(F.col("new_copies").isNull(), "removed").when(~same, "altered")
    return both.select("key", change.alias("change")).where("change IS NOT NULL")
