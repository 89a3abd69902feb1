"""Mixing documents to target domain weights by soft membership (operator 10).

A classifier fitted on the labelled table predicts each document's domain
posterior p_i. Nonnegative document rates r_i are fitted so that the expected
domain token totals, the sum of r_i t_i p_i over documents of t_i tokens, match
the targets: distributed projected-gradient least squares, every step one
aggregation of D sums over the compact ``(tokens, posterior)`` table. The
squared error is weighted by the inverse of the posteriors' token covariance
over the rows whose rate is not at its bound (projected gradients in the metric
of the active rows: a step of 1 fits any scale), and measured per token, so a
document's rate depends on its domains and not on its length.

The classifier (multinomial logistic regression on the presence of hashed words
that depend on a domain) is fitted on a bounded sample of labelled rows,
``PER_DOMAIN`` a domain (a documented parameter); its prior is set back to that
of all labelled rows. Posteriors, token totals and rates cover all documents.
"""

from __future__ import annotations

from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, packed, prepare, row_key, table, written
from labelsift.llm.langid import labelled_sample

PER_DOMAIN = 1200
FEATURES = 1 << 18
MAX_FEATURES = 2000
MIN_CHI2 = 12.0
# The query's domains, their target share of all tokens, and the domains that
# may fall below what the corpus has of them.
TARGETS = {"high": 0.84, "low": 0.14, "toxic": 0.02}
REDUCED = ("toxic",)
MAX_STEPS = 100
TOLERANCE = 1e-6
REWRITE = 16
_MEMO_WORDS = 300_000


def domain_label(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled row: toxic, else high or low by quality."""
    return F.when(toxic == 1, F.lit("toxic")).when(quality == 1, F.lit("high")) \
        .when(quality == 0, F.lit("low"))


class _Features:
    """Hashed features that a text has or has not: each distinct word's
    lower-cased core, the marks around words, and classes of the text's length,
    word variety, adjacent repeats and capitals."""

    def __init__(self):
        self.memo: dict[bytes, tuple] = {}

    def _word(self, w: bytes) -> tuple:
        core = w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        marks = w.replace(core, b"", 1)[:8] if core else w[:8]
        out = (crc32(core.lower()) % FEATURES,) if core else ()
        return (*out, crc32(b"\0" + marks) % FEATURES) if marks else out

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Word count and distinct features."""
        words = text.encode().split()
        if len(self.memo) > _MEMO_WORDS:
            self.memo.clear()
        memo, n, kinds, ids = self.memo, len(words), set(words), set()
        for w in kinds:
            f = memo.get(w)
            if f is None:
                f = memo[w] = self._word(w)
            ids.update(f)
        same = sum(map(eq, words, islice(words, 1, None)))
        upper = sum(map(bytes.isupper, words))
        for name, x in ((b"len", n.bit_length()), (b"kinds", 10 * len(kinds) // max(n, 1)),
                        (b"same", 10 * same // max(n, 1)), (b"upper", 10 * upper // max(n, 1))):
            ids.add(crc32(b"\1%s:%d" % (name, x)) % FEATURES)
        return n, np.fromiter(ids, dtype=np.int64, count=len(ids))


class DomainModel:
    """Multinomial logistic regression on the selected features; the last row
    of ``weights`` is the intercept. ``column[f]`` is a feature's row, -1 if it
    was not selected."""

    def __init__(self, domains: list[str], column: np.ndarray, weights: np.ndarray):
        self.domains, self.column, self.weights = domains, column, weights

    def posteriors(self, feats: list[np.ndarray]) -> np.ndarray:
        z = np.tile(self.weights[-1], (len(feats), 1))
        for i, f in enumerate(feats):
            c = self.column[f]
            z[i] += self.weights[c[c >= 0]].sum(0)
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _sample_features(batches):
    f = _Features()
    for b in blocks(batches):
        rows = [np.sort(f.of(t)[1]) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("lang"),
                               pa.array([i.astype("<i4").tobytes() for i in rows], pa.binary())],
                              names=["lang", "idx"])


def select_features(feats: list[np.ndarray], y: np.ndarray, most: int = MAX_FEATURES,
                    least: float = MIN_CHI2) -> np.ndarray:
    """Features in five rows or more whose presence depends on a domain:
    continuity-corrected chi-square of at least ``least``, the greatest
    ``most`` of them."""
    n = len(feats)
    idx = np.concatenate(feats) if feats else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(n), [len(f) for f in feats])
    df = np.bincount(idx, minlength=FEATURES).astype(np.float64)
    best = np.zeros(FEATURES)
    for c in range(y.shape[1]):
        has = np.bincount(idx, weights=y[owner, c], minlength=FEATURES)
        size = y[:, c].sum()
        gap = np.abs(has * (n - size - (df - has)) - (df - has) * (size - has)) - n / 2
        below = df * (n - df) * size * (n - size)
        best = np.maximum(best, np.where(below > 0, n * gap.clip(0) ** 2 / np.maximum(below, 1), 0))
    best[df < 5] = 0
    keep = np.flatnonzero(best >= least)
    return np.sort(keep[np.argsort(-best[keep], kind="stable")[:most]])


def fit_domains(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN,
                steps: int = 300, ridge: float = 1e-4) -> DomainModel:
    """Fit on ``labels(doc_id, domain)``; repeated labels of a document count
    as one (the least), labels without a document or a domain are ignored."""
    lab = written(labels.filter("doc_id is not null and domain is not null")
                  .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
                  .agg(F.min("domain").alias("lang")), "labels")
    # the sample is drawn on labels alone: at most per_domain ids a domain
    few = labelled_sample(lab.withColumn("text", F.lit("")), per_domain, keep=["doc_id"])
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")) \
        .join(F.broadcast(few.select("doc_id", "lang")), "doc_id") \
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = texts.select("lang", "text").mapInArrow(_sample_features, "lang string, idx binary").collect()
    got.sort(key=lambda r: (r["lang"], r["idx"]))
    domains = sorted({r["lang"] for r in got})
    column = np.full(FEATURES, -1, dtype=np.int64)
    if len(domains) < 2:
        return DomainModel(domains, column, np.zeros((1, len(domains))))
    feats = [np.frombuffer(r["idx"], "<i4").astype(np.int64) for r in got]
    y = np.array([[r["lang"] == d for d in domains] for r in got], dtype=np.float64)
    chosen = select_features(feats, y)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(feats), len(chosen) + 1))
    x[:, -1] = 1.0
    for i, f in enumerate(feats):
        c = column[f]
        x[i, c[c >= 0]] = 1.0
    w = np.zeros((len(chosen) + 1, len(domains)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):                 # Adam on the whole sample
        g = x.T @ (_softmax(x @ w) - y) / len(y) + ridge * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    counts = {r["lang"]: r["count"] for r in lab.groupBy("lang").count().collect()}
    true = np.array([counts[d] for d in domains], dtype=np.float64)
    w[-1] += np.log(true / true.sum()) - np.log(y.mean(0))
    return DomainModel(domains, column, w)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``(doc_id, text_hash, tokens, p ARRAY<DOUBLE>)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        f, m = _Features(), shared.value
        for b in blocks(batches):
            count, ps = [], []
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                rows = [f.of(t) for t in texts[at:at + 256]]
                count += [n for n, _ in rows]
                ps += m.posteriors([x for _, x in rows]).tolist()
            yield pa.record_batch(
                [b.column("doc_id"), b.column("text_hash"), pa.array(count, pa.int64()),
                 pa.array(ps, pa.list_(pa.float64()))], names=["doc_id", "text_hash", "tokens", "p"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text")) \
        .mapInArrow(run, "doc_id bigint, text_hash bigint, tokens bigint, p array<double>")


def target_totals(totals: np.ndarray, shares: np.ndarray, reduced: np.ndarray) -> np.ndarray:
    """Domain token totals in the target shares: the least overall total at
    which no domain outside ``reduced`` falls below what there is of it."""
    free = ~reduced & (shares > 0)
    if not free.any() or totals.sum() == 0:
        return shares * totals.sum()
    return shares * float((totals[free] / shares[free]).max())


def _stepped(rate: Column, moves: list[np.ndarray]) -> Column:
    """The rate after further projected-gradient moves (max(0, r - p . move))."""
    if not moves:
        return rate
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    return F.aggregate(steps, rate, lambda r, m: F.greatest(
        F.lit(0.0), r - F.aggregate(F.zip_with(m, F.col("p"), lambda a, b: a * b), F.lit(0.0),
                                    lambda s, x: s + x)))


def fit_rates(rows: DataFrame, targets: np.ndarray, max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE) -> tuple[DataFrame, int, float]:
    """``rows(..., tokens, p)``, written -> the rows with ``rate``, the steps
    taken and the last relative error. Rates start at 1. Ends when the totals
    match, or (targets out of reach of nonnegative rates) stop changing."""
    d = len(targets)
    rows = rows.withColumn("rate", F.lit(1.0))
    p = [F.col("p")[i] for i in range(d)]
    active = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
    moves: list[np.ndarray] = []
    before, scale = None, max(float(np.abs(targets).sum()), 1e-30)
    for k in range(max_steps + 1):
        now = rows.withColumn("rate", _stepped(F.col("rate"), moves))
        s = now.agg(*[F.sum(F.col("rate") * F.col("tokens") * q) for q in p],
                    *[F.sum(active * p[i] * p[j]) for i in range(d) for j in range(d)]).first()
        left = np.array([float(x or 0.0) for x in s[:d]]) - targets
        gram = np.array([float(x or 0.0) for x in s[d:]]).reshape(d, d)
        error = float(np.abs(left).sum()) / scale
        still = before is not None and np.abs(left - before).sum() <= 0.1 * tolerance * scale
        if error <= tolerance or still or k == max_steps:
            break
        before = left
        moves.append(np.linalg.pinv(gram + 1e-9 * max(gram.trace(), 1e-30) * np.eye(d)) @ left)
        if len(moves) >= REWRITE:      # keep the replay of moves short
            rows, moves = written(now.withColumn("rate", _stepped(F.col("rate"), moves[-1:])), "rates"), []
    return now, k, error


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = TARGETS,
        reduced: tuple = REDUCED, per_domain: int = PER_DOMAIN) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``(doc_id, text_hash, tokens,
    domain, p MAP, rate)``; ``labels(doc_id, domain)`` trains the classifier.

    Null text is empty: no tokens, and the posterior of the prior's logits.
    Domains without a label take no part and their share is spread over the
    rest; with fewer than two labelled domains every rate is 1. Repeated rows
    count each; an empty table gives no rows. Rates that have not settled after
    ``MAX_STEPS`` steps raise."""
    model = fit_domains(docs, labels, per_domain)
    names = model.domains
    if len(names) < 2:
        only = F.lit(names[0] if names else None).cast("string")
        text = F.coalesce(F.col("text"), F.lit(""))
        return docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
            F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("bigint").alias("tokens"),
            only.alias("domain"),
            (F.create_map(only, F.lit(1.0)) if names else
             F.create_map().cast("map<string,double>")).alias("p"), F.lit(1.0).alias("rate"))
    rows = written(posteriors(docs, model), "posteriors")
    s = rows.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(len(names))]).first()
    totals = np.array([float(x or 0.0) for x in s])
    share = np.array([shares.get(n, 0.0) for n in names])
    share = share / share.sum() if share.sum() else np.full(len(names), 1.0 / len(names))
    targets = target_totals(totals, share, np.array([n in reduced for n in names]))
    rated, steps, error = fit_rates(rows, targets)
    if steps >= MAX_STEPS:
        raise RuntimeError(f"the rates did not settle in {steps} steps (relative error {error:.2g})")
    keys = F.array(*[F.lit(n) for n in names])
    return rated.select(
        "doc_id", "text_hash", "tokens",
        F.element_at(keys, F.array_position("p", F.array_max("p")).cast("int")).alias("domain"),
        F.map_from_arrays(keys, "p").alias("p"), "rate")


def repeat_by_rate(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = TARGETS,
                   reduced: tuple = REDUCED) -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and
    one more where a hash of the row falls below the fraction. A row whose
    likeliest domain is not a reduced one stays at least once. Texts move once;
    rows that repeat id and text have one rate."""
    rated = mix(docs, labels, shares, reduced)
    draw = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    least = F.when(F.col("domain").isin(list(reduced)), 0).otherwise(1)
    times = rated.select(*row_key(F.col("doc_id"), F.col("text_hash")),
                         F.greatest(F.floor(F.col("rate") + draw), least).cast("int").alias("times")) \
        .groupBy("key_id", "key_hash").agg(F.max("times").alias("times")).filter("times > 0")
    return packed(docs).join(times, ["key_id", "key_hash"]) \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def quality_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", domain_label(F.col("quality"), F.col("toxic")).alias("domain"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = mix(table(spark, sf_dir, "documents"), quality_domains(spark, sf_dir))
    return out.select("doc_id", "tokens", "domain",
                      *[F.round(F.col("p")[d], 6).alias(f"p_{d}") for d in TARGETS],
                      F.round("rate", 6).alias("rate"))
