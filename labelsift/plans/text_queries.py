"""Registered queries for the text operators (build-plan step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsift.operators import poison as X
from labelsift.operators import tfidf as T
from labelsift.plans.common import CORPUS_SQL, RATE, SEED, corpus, docs, hash60_sql, poisoned_sql, r6
from labelsift.plans.text_sql import doc_freq_sql, term_counts_sql, tfidf_sql, vocab_sql
from labelsift.sources.corpus import train_test_split

TEST_RATE = 0.5
UNIGRAMS = T.TfidfConfig(name="unigrams")
UNIGRAMS_STOP = T.TfidfConfig(stop_words=T.ENGLISH_STOP_WORDS, name="unigrams_stop")


def _split(spark, sf, which):
    s = train_test_split(corpus(spark, sf), "row_id", TEST_RATE, SEED)
    return s.where(F.col("split") == which).drop("split")


def _mitigated_train(spark, sf):
    p = X.flip_labels(_split(spark, sf, "train"), "row_id", "label", RATE, SEED)
    return X.mitigate(p, "is_poisoned")


def _weights(df, cfg, apply=None, key="row_id"):
    if apply is None:
        return r6(T.fit_transform(df, key, "text", cfg)[1].select(key, "term", "weight"))
    vocab = T.fit(df, key, "text", cfg)
    return r6(T.transform(apply, key, "text", vocab).select(key, "term", "weight"))


def q_tokens(spark, sf):
    return T.term_counts(corpus(spark, sf), "row_id", "text", UNIGRAMS)


def q_stopped_tokens(spark, sf):
    return T.term_counts(corpus(spark, sf), "row_id", "text", UNIGRAMS_STOP)


def q_bigrams(spark, sf):
    return T.term_counts(corpus(spark, sf), "row_id", "text", T.EXPERIMENT)


def q_doc_freq(spark, sf):
    return T.doc_freq(corpus(spark, sf), "row_id", "text", T.DETECT)


def q_vocabulary_topk(spark, sf):
    return r6(T.fit(corpus(spark, sf), "row_id", "text", T.DETECT).table)


def q_tfidf_detect(spark, sf):
    return _weights(corpus(spark, sf), T.DETECT)


def q_tfidf_experiment(spark, sf):
    return _weights(_split(spark, sf, "train"), T.EXPERIMENT)


def q_tfidf_heldout_transform(spark, sf):
    return _weights(_split(spark, sf, "train"), T.EXPERIMENT, _split(spark, sf, "test"))


def q_tfidf_mitigation(spark, sf):
    return _weights(_mitigated_train(spark, sf), T.MITIGATION)


def q_tfidf_scan(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return _weights(d, T.SCAN, key="doc_id")


QUERIES = {
    "tokens": q_tokens,
    "stopped_tokens": q_stopped_tokens,
    "bigrams": q_bigrams,
    "doc_freq": q_doc_freq,
    "vocabulary_topk": q_vocabulary_topk,
    "tfidf_detect": q_tfidf_detect,
    "tfidf_experiment": q_tfidf_experiment,
    "tfidf_heldout_transform": q_tfidf_heldout_transform,
    "tfidf_mitigation": q_tfidf_mitigation,
    "tfidf_scan": q_tfidf_scan,
}

_CUT = int(TEST_RATE * (1 << 60))
TRAIN_SQL = f"SELECT * FROM ({CORPUS_SQL}) WHERE {hash60_sql(str(SEED), 'row_id')} >= {_CUT}"
TEST_SQL = f"SELECT * FROM ({CORPUS_SQL}) WHERE {hash60_sql(str(SEED), 'row_id')} < {_CUT}"
MITIGATED_SQL = f"SELECT * FROM ({poisoned_sql(SEED, RATE, TRAIN_SQL)}) WHERE is_poisoned = 0"
_DOCS = "SELECT doc_id, text FROM documents"


def _w(sql, key="row_id"):
    return f"SELECT {key}, term, round(weight, 6) AS weight FROM ({sql})"


ORACLE = {
    "tokens": term_counts_sql(CORPUS_SQL, UNIGRAMS),
    "stopped_tokens": term_counts_sql(CORPUS_SQL, UNIGRAMS_STOP),
    "bigrams": term_counts_sql(CORPUS_SQL, T.EXPERIMENT),
    "doc_freq": doc_freq_sql(CORPUS_SQL, T.DETECT),
    "vocabulary_topk": f"SELECT term, idx, df, ctf, round(idf, 6) AS idf FROM ({vocab_sql(CORPUS_SQL, T.DETECT)})",
    "tfidf_detect": _w(tfidf_sql(CORPUS_SQL, T.DETECT)),
    "tfidf_experiment": _w(tfidf_sql(TRAIN_SQL, T.EXPERIMENT)),
    "tfidf_heldout_transform": _w(tfidf_sql(TRAIN_SQL, T.EXPERIMENT, TEST_SQL)),
    "tfidf_mitigation": _w(tfidf_sql(MITIGATED_SQL, T.MITIGATION)),
    "tfidf_scan": _w(tfidf_sql(_DOCS, T.SCAN, key="doc_id"), key="doc_id"),
}
