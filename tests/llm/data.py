"""Small tables for the operator tests: nulls, empty and long texts, repeated
rows, and extra columns named like the operators' own."""

from __future__ import annotations

import random

CLASHES = ["fp", "key", "slice", "ghost", "part", "kept", "rate", "root", "component_id", "spans",
           "text_hash", "core", "extent", "n", "script", "grp", "cls", "_sd_n", "_q_i", "_m_n", "p"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, clash: bool = False):
    """rows: (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0",
             None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


def prose(rng: random.Random, n: int, words=None) -> str:
    words = words or ["the", "of", "river", "stone", "light", "über", "çela", "market", "seven",
                      "went", "home", "under", "green", "paper", "would", "carry", "small", "Tower"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 120)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, same), (4, same), (5, same), (6, long),
            (None, prose(rng, 80)), (None, None), (7, "one"), (8, "日本語 😀 текст"), (-3, "x" * 5000),
            (9, prose(rng, 90, ["ab", "cd"])), (10, "no letters 123 456"), (11, "123 456 !!")]
