"""TF-IDF as DataFrame operators.

Plan shape (one corpus):

* a document is one row, so tokens, term counts, weights and the L2 norm are
  row-local: tokens are cut by JVM expressions, ``counts`` turns them into a
  sorted ``(term, tf)`` array and ``vectorize`` looks the terms up in the
  broadcast vocabulary and weighs them, both in Arrow batches (dictionary codes,
  vectorised hash look-up, numpy). No exchange carries text or per-document
  terms by key up to a vocabulary of ``BROADCAST_MAX_TERMS``;
* the vocabulary is one ``explode`` and ``groupBy(term)`` with map-side partial
  aggregation (a term present in a third of all documents costs one row per
  partition);
* the top ``max_features`` cut is an exact threshold (distributed
  order-statistic search), not a single-task ``orderBy().limit()``;
* the fitted vocabulary has at most ``max_features`` rows, so it is broadcast
  into the transform (J3); without a cap its size is counted first, and above
  ``BROADCAST_MAX_TERMS`` the most frequent terms are looked up by broadcast
  and only the rare ones by a shuffle join, so no stop word meets in one task.

Semantics follow the reference's vectoriser: lower-case, tokens are runs of
two or more word characters, stop words removed before n-grams, n-grams
joined by one space, ``min_df`` / ``max_df`` pruning (absolute count or
proportion), top ``max_features`` by corpus count (ties by term), smoothed
``idf = ln((1+n)/(1+df)) + 1``, optional sublinear ``1 + ln(tf)``, L2 rows.
Null text is treated as '' (stated divergence: the reference's experiment
scripts would tokenise the string 'nan').
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from labelsift.functions.columns import text_or_empty
from labelsift.functions.stopwords import ENGLISH_STOP_WORDS
from labelsift.operators.ordinal import ordinal
from labelsift.operators.quantile import top_k
from labelsift.session import bound_batches, materialize, ship_package, spread, stored

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# (term, idx, idf) rows cost ~64 bytes each in a broadcast hash relation:
# 1M terms is ~64 MB on the driver and on every executor.
BROADCAST_MAX_TERMS = 1_000_000


@dataclass(frozen=True)
class TfidfConfig:
    max_features: int | None = None
    ngram_max: int = 1
    min_df: int | float = 1
    max_df: int | float = 1.0
    stop_words: tuple[str, ...] | None = None
    sublinear_tf: bool = False
    name: str = field(default="custom", compare=False)


# The four parameterisations used by the reference.
DETECT = TfidfConfig(3000, 1, 2, 0.95, ENGLISH_STOP_WORDS, False, "detect")
EXPERIMENT = TfidfConfig(20000, 2, 2, 1.0, ENGLISH_STOP_WORDS, False, "experiment")
MITIGATION = TfidfConfig(10000, 2, 1, 1.0, None, True, "mitigation")
SCAN = TfidfConfig(5000, 2, 1, 1.0, None, True, "scan")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def terms(text: Column | str, cfg: TfidfConfig) -> Column:
    """T1-T3 as one array expression: tokens, stop words removed, then
    1..ngram_max-grams of the remaining tokens."""
    toks = tokens(text)
    if cfg.stop_words:
        stop = list(cfg.stop_words)
        toks = F.filter(toks, lambda x: ~x.isin(stop))
    if cfg.ngram_max <= 1:
        return toks
    if cfg.ngram_max != 2:
        raise NotImplementedError("n-grams up to 2 (the reference uses 1 and 1-2)")
    n1 = F.greatest(F.size(toks) - 1, F.lit(0))
    bi = F.zip_with(F.slice(toks, 1, n1), F.slice(toks, 2, n1),
                    lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(toks, bi)


COUNTS = "array<struct<term:string,tf:bigint>>"
# Tokens or counts that a worker handles at once: some 20 numbers of 8 bytes are
# held for each, so this and not the size of a batch sets a worker's memory.
CHUNK_TOKENS = 1 << 17


def _pieces(offsets: np.ndarray, most: int | None = None):
    """Runs of rows of at most ``CHUNK_TOKENS`` tokens (a longer row alone)."""
    lo, n, most = 0, len(offsets) - 1, most or CHUNK_TOKENS
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _count_terms(tokens: pa.ListArray, cfg: TfidfConfig) -> pa.ListArray:
    """Token lists -> per row the distinct terms in term order with counts:
    tokens are dictionary codes, a pair of codes is a bigram, and equal
    ``(row, term rank)`` cells are counted by one sort."""
    n = len(tokens)
    coded = tokens.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(np.asarray(tokens.offsets)))
    if cfg.stop_words:
        stop = pc.is_in(names, value_set=pa.array(cfg.stop_words, names.type)).to_numpy(zero_copy_only=False)
        keep = ~stop[code]
        code, row = code[keep], row[keep]
    if cfg.ngram_max == 2:
        d = max(len(names), 1)
        near = row[1:] == row[:-1]
        pair, at = np.unique((code[:-1] * d + code[1:])[near], return_inverse=True)
        both = pc.binary_join_element_wise(names.take(pa.array(pair // d)), names.take(pa.array(pair % d)), " ")
        names = pa.concat_arrays([names, both])
        code, row = np.concatenate([code, d + at]), np.concatenate([row, row[:-1][near]])
    order = pc.array_sort_indices(names).to_numpy().astype(np.int64)
    rank = np.empty_like(order)
    rank[order] = np.arange(order.size)
    width = max(order.size, 1)
    cell, tf = np.unique(row * width + rank[code], return_counts=True)
    off = np.concatenate(([0], np.cumsum(np.bincount(cell // width, minlength=n)))).astype(np.int32)
    entry = pa.StructArray.from_arrays([names.take(pa.array(order[cell % width])), pa.array(tf.astype(np.int64))],
                                       names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(off), entry)


def counts(df: DataFrame, key: str, text: str, cfg: TfidfConfig, carry: Sequence[str] = ()) -> DataFrame:
    """T6, row-local: ``(key, *carry, counts)`` with the document's distinct
    terms in term order and their counts. Tokens are cut in the JVM (T1, T2);
    stop words, bigrams and counts are vectorised in Arrow batches (T3, T6)."""
    if cfg.ngram_max > 2:
        raise NotImplementedError("n-grams up to 2 (the reference uses 1 and 1-2)")
    cols = [key, *[c for c in carry if c != key]]
    cut = df.select(*cols, tokens(text).alias("_tokens"))
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi in _pieces(np.asarray(b.column("_tokens").offsets)):
                part = b.slice(lo, hi - lo)
                yield pa.record_batch([part.column(c) for c in cols] + [_count_terms(part.column("_tokens"), cfg)],
                                      names=[*cols, "counts"])

    schema = ST.StructType([cut.schema[c] for c in cols] + ST.StructType.fromDDL(f"counts {COUNTS}").fields)
    return cut.mapInArrow(run, schema)


def explode_counts(counted: DataFrame, key: str, keep_empty: bool = False) -> DataFrame:
    """``(key, term, tf)`` of row-local counts. With ``keep_empty`` a document
    without terms keeps one row with a null term."""
    ex = F.explode_outer if keep_empty else F.explode
    return counted.select(key, ex("counts").alias("_c")).select(key, "_c.term", "_c.tf")


def term_counts(df: DataFrame, key: str, text: str, cfg: TfidfConfig,
                keep_empty: bool = False) -> DataFrame:
    """Raw ``(key, term, tf)`` per document; no exchange."""
    return explode_counts(counts(df, key, text, cfg), key, keep_empty)


@dataclass
class Vocabulary:
    """A fitted vectoriser: ``table`` has ``term, idx, df, ctf, idf``."""
    table: DataFrame
    n_docs: int
    cfg: TfidfConfig
    size: int | None = None


def _bounds(cfg: TfidfConfig, n: int) -> tuple[float, float]:
    lo = cfg.min_df if isinstance(cfg.min_df, int) else cfg.min_df * n
    hi = cfg.max_df if isinstance(cfg.max_df, int) else cfg.max_df * n
    if hi < lo:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    return float(lo), float(hi)


def doc_freq(df: DataFrame, key: str, text: str, cfg: TfidfConfig) -> DataFrame:
    """T4 input: ``(term, df, ctf)`` -- documents containing the term and its
    corpus count; one partial-then-final aggregation on the term."""
    return doc_freq_from_counts(term_counts(df, key, text, cfg))


def doc_freq_from_counts(tc: DataFrame) -> DataFrame:
    return (tc.where(F.col("term").isNotNull()).groupBy("term")
              .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf")))


def fit(df: DataFrame, key: str, text: str, cfg: TfidfConfig,
        n_docs: int | None = None) -> Vocabulary:
    """Fit the vocabulary (at most ``max_features`` rows).

    ``n_docs`` counts every input row, including rows without any term.
    """
    n = int(n_docs if n_docs is not None else df.count())
    return fit_counts(term_counts(df, key, text, cfg), cfg, n)


def fit_counts(tc: DataFrame, cfg: TfidfConfig, n: int) -> Vocabulary:
    """Fit from precomputed ``(key, term, tf)`` counts of ``n`` documents."""
    return fit_doc_freq(doc_freq_from_counts(tc), cfg, n)


def fit_doc_freq(freq: DataFrame, cfg: TfidfConfig, n: int) -> Vocabulary:
    """Fit from ``(term, df, ctf)`` of ``n`` documents, one row a term."""
    lo, hi = _bounds(cfg, n)
    st = freq.where((F.col("df") >= lo) & (F.col("df") <= hi))
    if cfg.max_features is not None:
        # Top max_features by corpus count, ties by term; an exact
        # threshold instead of a single-task orderBy/limit
        st = top_k(stored(st, "terms"), "ctf", cfg.max_features, "term")
    if cfg.max_features is not None and cfg.max_features <= BROADCAST_MAX_TERMS:
        idx = F.row_number().over(Window.orderBy("term")) - 1
        table = st.select("term", idx.cast("int").alias("idx"), "df", "ctf")
    else:
        # the vocabulary may grow with the data: the index is a distributed
        # sort plus per-partition offsets, not a one-task window
        table = ordinal(st.select("term", "df", "ctf"), ["term"], "idx") \
            .select("term", F.col("idx").cast("int").alias("idx"), "df", "ctf")
    table = table.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)
    return Vocabulary(table, n, cfg, cfg.max_features)


def _vocab_size(vocab: Vocabulary) -> int:
    if vocab.size is None:
        vocab.size = vocab.table.count()
    return vocab.size


VECTOR = "indices array<int>, values array<double>"


def _row_weights(counts_col: pa.ListArray, terms_: pa.Array, idf: np.ndarray, sublinear: bool):
    """Per-row (offsets, term indices, L2-normalised weights) of a batch."""
    offsets = np.asarray(counts_col.offsets)
    flat = counts_col.flatten()
    idx = pc.index_in(pc.struct_field(flat, "term"), value_set=terms_)
    idx = idx.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts_col)), np.diff(offsets))
    tf = pc.struct_field(flat, "tf").to_numpy(zero_copy_only=False).astype(np.float64)
    known = idx >= 0
    idx, row, tf = idx[known], row[known], tf[known]
    w = (1.0 + np.log(tf) if sublinear else tf) * idf[idx]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(counts_col)))
    n = np.bincount(row, minlength=len(counts_col))
    return np.concatenate(([0], np.cumsum(n))).astype(np.int32), idx.astype(np.int32), w / norm[row]


def _ml_vectors(indices: pa.Array, values: pa.Array, size: int) -> pa.StructArray:
    """The storage form of Spark ML sparse vectors."""
    m = len(indices)
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, size, np.int32)), indices, values],
        names=["type", "size", "indices", "values"])


def vectorize(counted: DataFrame, key: str, vocab: Vocabulary, carry: Sequence[str] = (),
              as_vector: int | None = None) -> DataFrame:
    """T8, T9, J3, map-only: ``(key, *carry, indices, values)`` -- the row's
    known terms in index order with L2-normalised weights; rows without a known
    term get empty arrays. ``as_vector=size`` gives one Spark ML vector column
    ``features`` instead of the arrays. Above ``BROADCAST_MAX_TERMS`` terms the
    vectors come from joins on the term and meet the carried columns on the key,
    with the same rows (null keys excepted, which a join cannot match)."""
    cols = [key, *[c for c in carry if c != key]]
    if _vocab_size(vocab) > BROADCAST_MAX_TERMS:
        return _carried(counted.select(*cols), _vectorize_by_join(counted, key, vocab), key, as_vector)
    spark = counted.sparkSession
    ship_package(spark)
    bound_batches(spark)
    rows = vocab.table.select("idx", "term", "idf").toArrow().sort_by("idx")
    shared = spark.sparkContext.broadcast(
        (rows.column("term").combine_chunks(), rows.column("idf").to_numpy()))
    sub = vocab.cfg.sublinear_tf

    def run(batches):
        terms_, idf = shared.value
        most = max(CHUNK_TOKENS, len(terms_))  # each piece hashes the terms anew
        for b in batches:
            for lo, hi in _pieces(np.asarray(b.column("counts").offsets), most):
                part = b.slice(lo, hi - lo)
                off, idx, w = _row_weights(part.column("counts"), terms_, idf, sub)
                ind = pa.ListArray.from_arrays(pa.array(off), pa.array(idx))
                val = pa.ListArray.from_arrays(pa.array(off), pa.array(w))
                if as_vector is None:
                    out, names = [ind, val], ["indices", "values"]
                else:
                    out, names = [_ml_vectors(ind, val, as_vector)], ["features"]
                yield pa.record_batch([part.column(c) for c in cols] + out, names=[*cols, *names])

    schema = ST.StructType([counted.schema[c] for c in cols])
    if as_vector is None:
        schema = ST.StructType(schema.fields + ST.StructType.fromDDL(VECTOR).fields)
    else:
        from pyspark.ml.linalg import VectorUDT
        schema = schema.add("features", VectorUDT())
    return counted.select(*cols, "counts").mapInArrow(run, schema)


def _carried(rows: DataFrame, vecs: DataFrame, key: str, as_vector: int | None) -> DataFrame:
    """Vectors of a large vocabulary beside the columns that ride along: one
    join on the (unique) key; both sides have every key."""
    if as_vector is not None:
        from pyspark.ml.linalg import VectorUDT

        def pack(batches):
            for b in batches:
                yield pa.record_batch([b.column(key), _ml_vectors(b.column("indices"), b.column("values"), as_vector)],
                                      names=[key, "features"])

        vecs = vecs.select(key, "indices", "values").mapInArrow(
            pack, ST.StructType([vecs.schema[key]]).add("features", VectorUDT()))
    return vecs if rows.columns == [key] else rows.join(vecs, key)


def _vectorize_by_join(counted: DataFrame, key: str, vocab: Vocabulary) -> DataFrame:
    """The same for a vocabulary above the broadcast size: its
    ``BROADCAST_MAX_TERMS`` most frequent terms by broadcast join, the others
    -- each in few documents -- by shuffle join, regrouped by key."""
    table = vocab.table.select("term", "idx", "idf", "df")
    hot = materialize(top_k(table, "df", BROADCAST_MAX_TERMS, "term").select("term", "idx", "idf"))
    rare = table.join(F.broadcast(hot.select("term")), "term", "left_anti").select("term", "idx", "idf")
    tc = explode_counts(counted, key, keep_empty=True)
    first = tc.join(F.broadcast(hot), "term", "left")
    found = first.where("idx is not null or term is null").select(key, "term", "tf", "idx", "idf")
    more = first.where("idx is null and term is not null").select(key, "term", "tf").join(rare, "term", "left")
    j = found.unionByName(more.select(key, "term", "tf", "idx", "idf"))
    tf = F.col("tf").cast("double")
    w = (F.lit(1.0) + F.log(tf) if vocab.cfg.sublinear_tf else tf) * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy(key)))
    return vectors(j.select(key, "term", "idx", F.when(norm > 0, w / norm).otherwise(w).alias("weight")), key)


def weights(vecs: DataFrame, key: str, vocab: Vocabulary, keep_empty: bool = False) -> DataFrame:
    """``(key, term, idx, weight)`` rows of vectors. With ``keep_empty``
    documents without known terms keep one row of nulls."""
    ex = F.explode_outer if keep_empty else F.explode
    e = vecs.select(key, ex(F.arrays_zip("indices", "values")).alias("_e")) \
        .select(key, F.col("_e.indices").alias("idx"), F.col("_e.values").alias("weight"))
    names = vocab.table.select("idx", "term")
    if _vocab_size(vocab) <= BROADCAST_MAX_TERMS:
        names = F.broadcast(names)
    return e.join(names, "idx", "left").select(key, "term", "idx", "weight")


def transform(df: DataFrame, key: str, text: str, vocab: Vocabulary,
              keep_empty: bool = False) -> DataFrame:
    """T6, T8, T9, J3 from texts: ``(key, term, idx, weight)``."""
    return weights(vectorize(counts(df, key, text, vocab.cfg), key, vocab), key, vocab, keep_empty)


def vectors(weights: DataFrame, key: str) -> DataFrame:
    """Sparse rows ``(key, indices array<int>, values array<double>)`` ordered by
    index. Rows with a null index (documents without terms) give empty arrays.
    Grouping by key reuses the key partitioning of ``transform``."""
    entry = F.when(F.col("idx").isNotNull(), F.struct(F.col("idx"), F.col("weight")))
    agg = weights.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return agg.select(key, F.transform("_e", lambda e: e["idx"]).alias("indices"),
                      F.transform("_e", lambda e: e["weight"]).alias("values"))


def fit_vectors(df: DataFrame, key: str, text: str, cfg: TfidfConfig,
                n_docs: int | None = None, carry: Sequence[str] = ()) -> tuple[Vocabulary, DataFrame, DataFrame]:
    """Tokenise once: the counts are stored, the vocabulary is fitted on them
    and the vectors are a map over them. Returns ``(vocabulary, stored counts,
    vectors)``; ``carry`` columns (the text, labels) ride along both."""
    counted = stored(counts(spread(df), key, text, cfg, carry), "counts")
    n = int(n_docs if n_docs is not None else counted.count())
    vocab = fit_counts(explode_counts(counted, key), cfg, n)
    vocab.table = materialize(vocab.table)
    vocab.size = vocab.table.count()
    return vocab, counted, vectorize(counted, key, vocab, carry)


def fit_transform(df: DataFrame, key: str, text: str, cfg: TfidfConfig,
                  keep_empty: bool = False, n_docs: int | None = None) -> tuple[Vocabulary, DataFrame]:
    vocab, _, vecs = fit_vectors(df, key, text, cfg, n_docs)
    return vocab, weights(vecs, key, vocab, keep_empty)
