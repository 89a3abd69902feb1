"""URL filters by a cascade of Bloom filters (operator 3), in DataFrame
functions only.

Level 0 encodes the listed keys. Every further level encodes the false
positives of the one before among the other side of the complete key universe,
until none is left; the parity of the first level that rejects a key then
decides membership exactly for every key of the universe, without a join: a
level is one row (an array of 64-bit words) that reaches the tasks as an
uncorrelated scalar subquery. A list whose first level would exceed
``MAX_WORDS`` is matched by a left join on the key instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import prepare, table, written

BITS_PER_KEY = 12
HASHES = 5
MAX_WORDS = 1 << 22  # 32 MB a level: what a task may be sent

# The rules of the query's contract: (verdict, host, path), fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _position(key: Column, level: int, j: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(words * 64).cast("bigint"))


class _Level:
    """One Bloom filter: a one-row table of words and its size."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level = level
        self.words = max(1, -(-n * BITS_PER_KEY // 64))
        spark = keys.sparkSession
        at = F.explode(F.array(*[_position(F.col("key"), level, j, self.words)
                                 for j in range(HASHES)]))
        word = F.shiftright("at", 6).alias("word")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"),
                              F.pmod("at", F.lit(64)).cast("int")).alias("bits")
        zero = spark.range(self.words).select(F.col("id").alias("word"),
                                              F.lit(0).cast("bigint").alias("bits"))
        full = keys.select(at.alias("at")).select(word, bit).unionByName(zero) \
            .groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = full.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
        self.row = written(row.select(F.col("w.bits").alias("words")), "bloom")

    def holds(self, key: Column) -> Column:
        words = self.row.scalar()
        tests = []
        for j in range(HASHES):
            at = _position(key, self.level, j, self.words)
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            tests.append(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership in ``listed(key)`` for every key of ``universe(key)``
    (and of the list itself). Null keys are never listed."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        both = universe.select("key", F.lit(0).alias("l")).unionByName(
            listed.select("key", F.lit(1).alias("l"))).filter("key is not null")
        keys = written(both.groupBy("key").agg(F.max("l").alias("l")), "universe")
        inside, outside = keys.filter("l = 1").select("key"), keys.filter("l = 0").select("key")
        self.levels: list[_Level] = []
        self.list_table = inside
        n = inside.count()
        self.too_large = n * BITS_PER_KEY > MAX_WORDS * 64
        while n and not self.too_large:
            level = _Level(inside, n, len(self.levels))
            self.levels.append(level)
            false_pos = written(outside.filter(level.holds(F.col("key"))), "falsepos")
            inside, outside, n = false_pos, inside, false_pos.count()

    def contains(self, key: Column) -> Column:
        """Member or not; only for a list within the size bound."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))

    def mark(self, df: DataFrame, column: str, key: Column) -> DataFrame:
        """``df`` with a boolean membership column: by the cascade, or by a
        left join where the list exceeds the size that a task may be sent."""
        if not self.too_large:
            return df.withColumn(column, self.contains(key))
        hit = self.list_table.select(F.col("key").alias("_c_key"), F.lit(True).alias("_c_hit"))
        return df.join(hit, key == F.col("_c_key"), "left") \
            .withColumn(column, F.coalesce("_c_hit", F.lit(False))).drop("_c_key", "_c_hit")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (F.coalesce(host, F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def candidate_keys(host: Column, path: Column, rules: list[tuple]) -> list[Column]:
    """The keys under which a rule could fit a url: the host's last labels and
    the path's first characters, for each (labels, length) that rules have.
    Longest host first among equals; null where host or path are shorter."""
    shapes = sorted({(h.count(".") + 1, len(h), len(p)) for _, h, p in rules}, reverse=True)
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    out = []
    for n, k in sorted({(n, k) for n, _, k in shapes}, reverse=True):
        out.append(F.when((labels >= n) & (F.length(path) >= k),
                          F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k))))
    return out


def judge_urls(pages: DataFrame, rules: list[tuple] = RULES, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per input row: ``(id, host, path, rule, verdict)``.

    A rule fits its host and subdomains where the path starts with the rule's
    path; the longest wins (equal lengths: the longer host). Without a fitting
    rule the host list decides: a host is listed if a block rule has caught a
    page of it; its other pages are blocked too, all else is allowed. Block
    keys, allow keys and listed hosts are one cascade each, over all candidate
    keys and hosts of the table. Null urls, and urls without ``://``, have an
    empty host and path and are allowed; repeated rows are judged each."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    cands = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = split.select(F.explode(F.array(*cands)).alias("key")).filter("key is not null").distinct()
    universe = written(universe, "candidates")
    cascades = {}
    for verdict in ("block", "allow"):
        keys = [(h + p,) for v, h, p in rules if v == verdict]
        cascades[verdict] = Cascade(universe, spark.createDataFrame(keys, "key string"))
    fits = [F.when(cascades[v].contains(c), F.struct(
        F.length(c).alias("n"), F.lit(-i).alias("i"), c.alias("rule"), F.lit(v).alias("verdict")))
        for i, c in enumerate(cands) for v in ("block", "allow")]
    best = F.array_max(F.array_compact(F.array(*fits)))
    judged = split.withColumn("best", best)
    hosts = written(judged.groupBy("host").agg(
        F.max(F.coalesce(F.col("best.verdict") == "block", F.lit(False))).alias("caught")), "hosts")
    listing = Cascade(hosts.select(F.col("host").alias("key")),
                      hosts.filter("caught").select(F.col("host").alias("key")))
    out = listing.mark(judged, "_listed", F.col("host"))
    return out.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"),
                   F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge_urls(table(spark, sf_dir, "pages"))


def _rules_sql() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


OP3_SQL = f"""
WITH s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r(verdict, h, p) AS (VALUES {_rules_sql()}),
b AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id
                            ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)),
l AS (SELECT DISTINCT host FROM b WHERE k = 1 AND verdict = 'block')
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM b WHERE k = 1
"""
