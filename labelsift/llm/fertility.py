"""Quality rules by tokeniser fertility (operator 6).

Public vocabularies measure how well a text fits real writing: characters per
token (a byte-fallback piece vocabulary and a byte-level vocabulary), the share
of byte-fallback pieces and the entropy of the text's pieces. Each measure has
a rejection band per language (per script where the language is null) and
length class: fences ``FENCE`` interquartile ranges, and never less than
``LEAST``, outside the quartiles of the distinct texts of that group, drawn
towards fixed bands that weigh as much as ``PRIOR`` texts: one rule at every size.

Words are tokenised once per block of texts and remembered (a bounded memo), as
no piece of the vocabularies crosses white space.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, packed, prepare, row_key, table, written

FENCE = 3.0                 # the usual bound of far outliers
PRIOR = 2
GRAIN = 1000                # quartiles are taken of measures in thousandths
BROADCAST_BANDS = 100_000   # more groups than these are joined by shuffle
# Fixed bands (least, greatest) that a group's own are drawn towards.
FIXED = {"piece_chars": (0.5, 12.0), "byte_chars": (0.25, 16.0), "fallback": (0.0, 0.5),
         "entropy": (1.0, 20.0)}
MEASURES = list(FIXED)
# Least distance of a fence from its quartile: a share of the median, for byte
# fallback an absolute share on top of the pieces of one rare sign.
LEAST = {"piece_chars": 0.05, "byte_chars": 0.05, "fallback": 0.02, "entropy": 0.05}
SIGN_PIECES = 4
MIN_WORDS = 50
_MEMO_WORDS = 300_000
_BLOCK = 1 << 20
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return (public_tokenizers.path("piece_bpe_32k.model"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=4)
def _load(piece_path: str, byte_path: str):
    import public_tokenizers
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    with open(byte_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    level = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    return pieces, level, is_byte


class _Words:
    """Memo of words: an id each, and their tokens."""

    def __init__(self, paths: tuple[str, str]):
        self.pieces, self.level, self.is_byte = _load(*paths)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.chars, self.byte_tokens = array("q"), array("q")
        self.first, self.tokens = array("q", [0]), array("i")

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > _MEMO_WORDS:
            self.reset()
        ids = self.ids
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            text = [w.decode() for w in new]
            for w, t, p in zip(new, text, self.pieces.encode(text, num_threads=1)):
                ids[w] = len(ids)
                self.chars.append(len(t))
                self.byte_tokens.append(len(self.level.encode_ordinary(" " + t)))
                self.tokens.extend(p)
                self.first.append(len(self.tokens))
        return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def _repeat_words(row: np.ndarray, word: np.ndarray, n_rows: int) -> np.ndarray:
    """Words per row inside a three-word window that its row holds twice."""
    out = np.zeros(n_rows, dtype=np.int64)
    if len(word) < 3:
        return out
    words, word = np.unique(word, return_inverse=True)
    n = np.int64(len(words))
    ok = row[:-2] == row[2:]
    # ranks of (row, first, second), then of that and the third: exact
    two = (row[:-2] * n + word[:-2]) * n + word[1:-1] if n_rows * int(n) ** 2 < 1 << 62 else \
        np.unique(row[:-2] * n + word[:-2], return_inverse=True)[1] * n + word[1:-1]
    two = np.unique(two, return_inverse=True)[1]
    _, three, count = np.unique((two * n + word[2:])[ok], return_inverse=True, return_counts=True)
    at = np.flatnonzero(ok)[count[three] > 1]
    hit = np.zeros(len(word), dtype=bool)
    for k in range(3):
        hit[at + k] = True
    return out + np.bincount(row[hit], minlength=n_rows)


def _script(text: str) -> str:
    """Script with the most letters, by code point block: Latn, Grek, Cyrl,
    Arab, Deva, CJK or Zyyy (other or none)."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    part = np.searchsorted(np.array([0x41, 0x370, 0x400, 0x530, 0x600, 0x700, 0x900, 0x980,
                                     0x3040, 0xD7B0]), c, side="right")
    n = np.bincount(part, minlength=11)
    kinds = {"Latn": n[1], "Grek": n[2], "Cyrl": n[3], "Arab": n[5], "Deva": n[7], "CJK": n[9]}
    best = max(kinds, key=lambda k: kinds[k])
    return best if kinds[best] else "Zyyy"


def _measure_block(texts: list[str], memo: _Words) -> dict:
    raw = [t.encode() for t in texts]
    split = [b.split() for b in raw]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), n_words)
    word = memo.of([w for ws in split for w in ws])

    def per_row(v):
        return np.bincount(row, weights=v, minlength=len(texts))

    chars = np.frombuffer(memo.chars, dtype=np.int64)[word] if len(word) else word
    first = np.frombuffer(memo.first, dtype=np.int64)
    size = first[word + 1] - first[word]
    tokens = per_row(size)
    byte_tokens = per_row(np.frombuffer(memo.byte_tokens, dtype=np.int64)[word]) if len(word) \
        else np.zeros(len(texts))
    flat = np.frombuffer(memo.tokens, dtype=np.int32)
    at = np.repeat(first[word] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size,
                   size) + np.arange(int(size.sum()))
    ids, owner = flat[at].astype(np.int64), np.repeat(row, size)
    fallback = np.bincount(owner[memo.is_byte[ids]], minlength=len(texts))
    v = len(memo.is_byte)
    key, count = np.unique(owner * v + ids, return_counts=True)
    owner = key // v
    p = count / tokens[owner]
    entropy = np.bincount(owner, weights=-p * np.log2(p), minlength=len(texts))
    n_chars = per_row(chars).astype(np.int64)
    dup = []
    for b in raw:
        lines = [x for x in b.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    safe = np.maximum(tokens, 1)
    return {"n_words": n_words, "word_chars": n_chars,
            "n_symbols": np.array([len(b) - len(b.translate(None, _SYMBOLS)) for b in raw], np.int64),
            "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": _repeat_words(row, word, len(texts)),
            "script": [_script(t) for t in texts], "n_tokens": tokens.astype(np.int64),
            "piece_chars": n_chars / safe, "byte_chars": n_chars / np.maximum(byte_tokens, 1),
            "fallback": fallback / safe, "entropy": entropy}


_SCHEMA = ("doc_id bigint, text_hash bigint, lang string, n_words bigint, word_chars bigint, "
           "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, script string, "
           "n_tokens bigint, piece_chars double, byte_chars double, fallback double, entropy double")


def _measure(paths: tuple[str, str]):
    def run(batches):
        memo = _Words(paths)
        for b in blocks(batches):
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= _BLOCK:
                    size += len(texts[end])
                    end += 1
                m = _measure_block(texts[at:end], memo)
                part = b.slice(at, end - at)
                yield pa.record_batch(
                    [part.column(c) for c in ("doc_id", "text_hash", "lang")]
                    + [pa.array(v, pa.string() if k == "script" else pa.float64() if k in FIXED
                                else pa.int64()) for k, v in m.items()],
                    names=["doc_id", "text_hash", "lang", *m])
                at = end
    return run


def measures(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Counts and tokeniser measures of ``docs(doc_id, text[, lang])``."""
    paths = vocabularies or default_vocabularies()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(text).alias("text_hash"), lang.alias("lang"), text.alias("text"))
    return rows.mapInArrow(_measure(paths), _SCHEMA)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quartiles(texts: DataFrame) -> DataFrame:
    """``(b_grp, b_cls, n, q_<measure> ARRAY)`` of ``texts(grp, cls, measures)``:
    the least thousandths that a quarter, half and three quarters of the group's
    texts do not exceed. Counts per thousandth combine before the shuffle and a
    group has a few ten thousand of them at most, so the result is exact under any
    partitioning and a hot group is no large task."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(F.col(m) * GRAIN).cast("bigint").alias("v"))
                               for m in MEASURES]))
    counts = texts.select("grp", "cls", each.alias("e")).groupBy("grp", "cls", "e.m", "e.v").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("grp", "cls", "m")
    upto, n = F.sum("c").over(whole.orderBy("v")), F.sum("c").over(whole)
    reached = counts.select("grp", "cls", "m", "v", upto.alias("upto"), n.alias("n"))
    least = [F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("v"))) / GRAIN for k in (1, 2, 3)]
    per = reached.groupBy("grp", "cls", "m").agg(F.max("n").alias("n"), F.array(*least).alias("q"))
    return per.groupBy(F.col("grp").alias("b_grp"), F.col("cls").alias("b_cls")).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("m") == m, F.col("q"))).alias(f"q_{m}") for m in MEASURES])


def judge(docs: DataFrame, vocabularies: tuple[str, str] | None = None,
          fence: float = FENCE) -> DataFrame:
    """One row per input row of ``docs(doc_id, text[, lang])``: the base counts,
    ``base_failed``, the measures, ``method_ok`` and ``kept``.

    ``kept`` is false where the base rules fail, else true if every measure
    lies in the band of its language (script) and length class. Null and empty
    texts have no words and fail the base rules; repeated rows are judged each,
    but a text counts once in the quartiles; null languages are judged by script; an
    empty table gives no rows."""
    rows = written(measures(docs, vocabularies).withColumn("base_failed", _base_failed()), "measures")
    group = F.coalesce(F.col("lang"), F.col("script")).alias("grp")
    size = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int").alias("cls")
    texts = rows.filter(~F.col("base_failed")).groupBy(group, size, "text_hash") \
        .agg(*[F.min(m).alias(m) for m in MEASURES])
    bands = written(quartiles(texts), "bands")
    if bands.count() <= BROADCAST_BANDS:
        bands = F.broadcast(bands)
    joined = rows.join(bands, (F.coalesce("lang", "script") == F.col("b_grp")) & (size == F.col("b_cls")),
                       "left")
    inside = F.lit(True)
    for m in MEASURES:
        q1, mid, q3 = (F.col(f"q_{m}")[i] for i in range(3))
        least = LEAST[m] + SIGN_PIECES / F.greatest("n_tokens", F.lit(1)) if m == "fallback" else LEAST[m] * mid
        reach = F.greatest(fence * (q3 - q1), least)
        own = F.coalesce(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))
        low = F.coalesce(own * (q1 - reach), F.lit(0.0)) + (1 - own) * FIXED[m][0]
        high = F.coalesce(own * (q3 + reach), F.lit(0.0)) + (1 - own) * FIXED[m][1]
        inside = inside & F.col(m).between(low - 1e-9, high + 1e-9)
    return joined.select("doc_id", "text_hash", *_COUNTS, "base_failed", *MEASURES,
                         inside.alias("method_ok"),
                         (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns. Texts are
    shuffled once, against the ids and text hashes of the kept rows."""
    kept = judge(docs, vocabularies).filter("kept") \
        .select(*row_key(F.col("doc_id"), F.col("text_hash"))).distinct()
    return packed(docs).join(kept, ["key_id", "key_hash"], "left_semi").select("row.*")


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge(table(spark, sf_dir, "documents")).drop("text_hash", "method_ok")
