"""Language identification with string kernels (operator 2).

Blended-spectrum presence kernel: k(x, y) counts the distinct character-code
n-grams (n = 1 to 3 over lower-cased UTF-8, everything that is no letter byte
folded into one separator) that two texts share, divided by the root of
k(x, x) k(y, y). A bounded sample of labelled texts gives Nystrom landmarks and
training rows; one-versus-rest kernel ridge regression is solved on the
Nystrom features. As the kernel is linear in presence, landmarks and
coefficients fold into one gram-by-language matrix, and a block of texts is
scored by one product of its sparse presence matrix with that matrix: the
model's size depends on the alphabet of the landmarks, not on the corpus.

Bounds of the fit (documented parameters): ``PER_LANG`` labelled rows a
language, ``LANDMARKS`` landmarks in all. Every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, keyed_text, prepare, table

PER_LANG = 1000
LANDMARKS = 384
RIDGE = 1e-3
UNKNOWN = "und"
_BASE = 155                     # separator, a-z, 128 bytes above ASCII
_CELLS = 1 << 23                # presence cells of one block
_LETTER = regex.compile(r"\p{L}")


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


def _presence(texts: list[bytes], classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as sorted (row, gram) pairs; ``classes``
    maps bytes to ``size`` classes."""
    n = [len(t) for t in texts]
    grams = size + size ** 2 + size ** 3
    c = classes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    cells = np.zeros(len(texts) * grams, dtype=bool)
    base = row * grams
    cells[base + c] = True
    two = c[:-1] * size + c[1:]
    ok = row[:-1] == row[1:]
    cells[(base[:-1] + (size + two))[ok]] = True
    three = two[:-1] * size + c[2:]
    ok = row[:-2] == row[2:]
    cells[(base[:-2] + (size + size ** 2 + three))[ok]] = True
    at = np.flatnonzero(cells)
    rows = at // grams
    return rows, at - rows * grams


@dataclass
class LanguageModel:
    """``weights[g, c]``: what gram ``g``'s presence adds to language ``c``
    before division by the root of the text's gram count."""
    languages: list[str]
    classes: np.ndarray
    size: int
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression outputs, one row per (non-empty) text."""
        out = np.empty((len(texts), len(self.languages)))
        raw = [t.lower().encode() for t in texts]
        grams = self.size + self.size ** 2 + self.size ** 3
        most = max(1, _CELLS // grams)
        at = 0
        while at < len(raw):
            end, held = at + 1, len(raw[at])
            while end < len(raw) and end - at < most and held + len(raw[end]) <= 1 << 20:
                held += len(raw[end])
                end += 1
            rows, cols = _presence(raw[at:end], self.classes, self.size)
            start = np.searchsorted(rows, np.arange(end - at))
            total = np.add.reduceat(self.weights[cols], start, axis=0, dtype=np.float64)
            count = np.diff(np.append(start, len(rows)))
            out[at:end] = total / np.sqrt(count)[:, None] + self.bias
            at = end
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score; ``und`` with score 0 without a letter (or
        without any learned language)."""
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages:
            use = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            if use:
                f = self.scores([texts[i] for i in use])
                best = f.argmax(1)
                for i, b in zip(use, best.tolist()):
                    langs[i] = self.languages[b]
                score[use] = np.clip(f[np.arange(len(use)), best], 0.0, 1.0)
        return langs, score


def _sample_grams(batches):
    for b in blocks(batches):
        out = []
        for lang, order, text in zip(*(b.column(c).to_pylist() for c in ("lang", "k", "text"))):
            _, cols = _presence([text.lower().encode()], _byte_classes(), _BASE)
            out.append((lang, order, cols.astype("<i4").tobytes()))
        if out:
            lang, order, grams = zip(*out)
            yield pa.record_batch([pa.array(lang), pa.array(order, pa.int32()),
                                   pa.array(grams, pa.binary())], names=["lang", "k", "grams"])


def labelled_sample(rows: DataFrame, per_lang: int, keep: list[str] | None = None) -> DataFrame:
    """At most ``per_lang`` rows ``(lang, k, text)`` (and the columns ``keep``)
    a language, the least by a hash of the row; k counts from 1. Rows far above
    the cut are dropped before the ranking, so the ranking holds a bounded
    number of rows."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows.select("lang", F.lit(1).alias("k"), "text", *(keep or [])).limit(0)
    share = F.create_map(*[x for k, n in counts.items() for x in (
        F.lit(k), F.lit(min(1.0, (2.0 * per_lang + 100) / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")))
    k = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    return few.withColumn("k", k).filter(F.col("k") <= per_lang) \
        .select("lang", "k", "text", *(keep or []))


def fit(rows: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> LanguageModel:
    """Fit on ``rows(doc_id, text, lang)``, lang not null, text with a letter."""
    got = labelled_sample(rows, per_lang).mapInArrow(
        _sample_grams, "lang string, k int, grams binary").collect()
    got.sort(key=lambda r: (r["k"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return LanguageModel([], _byte_classes(), 1, np.zeros((3, 0)), np.zeros(0))
    grams = [np.frombuffer(r["grams"], dtype="<i4").astype(np.int64) for r in got]
    marks = grams[:landmarks]
    # fold the alphabet to the classes that landmarks have, plus one for the rest
    seen = np.unique(np.concatenate([g[g < _BASE] for g in marks]))
    size = len(seen) + 1
    new = np.full(_BASE, size - 1, dtype=np.int64)
    new[seen] = np.arange(len(seen))

    def fold(g: np.ndarray) -> np.ndarray:
        one, rest = g[g < _BASE], g[g >= _BASE] - _BASE
        two, three = rest[rest < _BASE ** 2], rest[rest >= _BASE ** 2] - _BASE ** 2
        return np.unique(np.concatenate((
            new[one], size + new[two // _BASE] * size + new[two % _BASE],
            size + size ** 2 + (new[three // _BASE ** 2] * size + new[three // _BASE % _BASE]) * size
            + new[three % _BASE])))

    grams = [fold(g) for g in grams]
    marks = grams[:landmarks]
    vocab = np.unique(np.concatenate(marks))

    def dense(gs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(gs), len(vocab)), dtype=np.float32)
        for i, g in enumerate(gs):
            at = np.minimum(np.searchsorted(vocab, g), len(vocab) - 1)
            x[i, at[vocab[at] == g]] = 1.0
            x[i] /= np.sqrt(len(g))
        return x

    marks_x = dense(marks)
    k_mm = (marks_x @ marks_x.T).astype(np.float64)
    val, vec = np.linalg.eigh(k_mm)
    keep = val > 1e-6 * val[-1]
    root = vec[:, keep] / np.sqrt(val[keep])         # K_mm^(-1/2), low ranks dropped
    phi = np.concatenate([(dense(grams[i:i + 256]) @ marks_x.T).astype(np.float64) @ root
                          for i in range(0, len(grams), 256)])
    y = np.array([[r["lang"] == c for c in langs] for r in got], dtype=np.float64)
    mean_phi, mean_y = phi.mean(0), y.mean(0)
    p = phi - mean_phi
    coef = np.linalg.solve(p.T @ p + ridge * len(got) * np.eye(p.shape[1]), p.T @ (y - mean_y))
    weights = np.zeros((size + size ** 2 + size ** 3, len(langs)), dtype=np.float32)
    weights[vocab] = marks_x.T @ (root @ coef).astype(np.float32)
    return LanguageModel(langs, new[_byte_classes()], size, weights, mean_y - mean_phi @ coef)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row; null text is empty (und)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in blocks(batches):
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                  names=["doc_id", "lang_pred", "score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The contract's held-out part; a null id is neither learned from nor
    held out."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def identify(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    """Fit on the learnable rows of ``docs(doc_id, text, lang)`` and predict
    all: ``(doc_id, held_out, lang_pred, score)``. Without a learnable row, and
    for texts that are null or have no letter, the prediction is ``und`` with
    score 0; repeated rows are predicted each; an empty table gives no rows."""
    learn = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    learn = learn.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                         & F.col("text").rlike(r"\p{L}"))
    out = predict(docs, fit(learn, per_lang, landmarks))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                      "lang_pred", "score")


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return identify(table(spark, sf_dir, "documents"))
