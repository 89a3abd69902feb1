"""Shared pieces of the registered queries: driver-table readers, the corpus
view and output rounding (floats are compared at 6 dp, SURVEY H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.sources.corpus import driver_corpus, table

SEED = 42
RATE = 0.05


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return driver_corpus(spark, sf)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` places (display contract)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# --- SQL fragments for the oracle side -------------------------------------

CORPUS_SQL = ("SELECT d.doc_id AS row_id, d.text AS text, l.quality AS label "
              "FROM documents d JOIN labels l USING (doc_id)")


def hash60_sql(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15))::BIGINT"


def poisoned_sql(seed: int = SEED, rate: float = RATE, source: str = CORPUS_SQL) -> str:
    """Oracle form of X1+X2: plain ``row_number()`` over the hash (ties by key)."""
    return f"""
    SELECT row_id, text,
           CASE WHEN rn <= k THEN 1 - label ELSE label END AS label,
           label AS original_label,
           CASE WHEN rn <= k THEN 1 ELSE 0 END AS is_poisoned
    FROM (SELECT c.*, row_number() OVER (ORDER BY {hash60_sql(str(seed), 'row_id')}, row_id) AS rn,
                 floor(count(*) OVER () * {float(rate)!r}::DOUBLE) AS k
          FROM ({source}) c)"""


def standin_flag_sql(seed: int, rate: float, source: str, key: str = "row_id") -> str:
    """Stand-in detector flag: the first floor(n*rate) rows by md5('flag:seed:key')."""
    return f"""
    SELECT s.*, CASE WHEN rn2 <= k2 THEN 1 ELSE 0 END AS detector_flag
    FROM (SELECT c.*, row_number() OVER (ORDER BY {hash60_sql('flag:' + str(seed), key)}, {key}) AS rn2,
                 floor(count(*) OVER () * {float(rate)!r}::DOUBLE) AS k2
          FROM ({source}) c) s"""


STRIP_SQL = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP_SQL.format(x=x)
