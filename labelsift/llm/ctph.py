"""Document fingerprints by context-triggered piecewise hashing (operator 1).

A rolling hash over the last seven bytes triggers a chunk boundary where it
hits the block size's residue (block sizes are 3 * 2^k, so the boundaries of a
block size are among those of the next smaller one); each chunk gives one
base-64 character. A fingerprint ``block:signature:signature`` holds the
signatures at the block size and at twice the block size. Two fingerprints are
compared by edit distance (insertions and deletions) of the signatures they
have at a common block size, given a common run of seven characters.

Fingerprints are computed in numpy over many texts at once; the scan and the
signatures hold for whole texts of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, keyed_text, prepare, shuffle_width, table

WINDOW = 7
SIGNATURE = 64      # characters at the block size; half as many at twice that
MIN_BLOCK = 3
COMMON_RUN = 7
_CHUNK = 1 << 18    # bytes scanned at once (a longer text is one chunk)
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARS = np.frombuffer(_B64.encode(), dtype=np.uint8)
_GAP = b"\0" * WINDOW


def _rolling(x: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: weighted sum plus shifted xor of the last
    seven bytes."""
    x = x.astype(np.uint32)
    add, mix = x * np.uint32(8), x.copy()
    for j in range(1, WINDOW):
        add[j:] += x[:-j] * np.uint32(8 - j)
        mix[j:] ^= x[:-j] << np.uint32(5 * j)
    add += mix
    return add


def _level(n: np.ndarray) -> np.ndarray:
    """Least k with 3 * 2^k * 64 >= n."""
    k = np.zeros(len(n), dtype=np.int64)
    for _ in range(64):
        low = (MIN_BLOCK << k) * SIGNATURE < n
        if not low.any():
            break
        k[low] += 1
    return k


def _scan(texts: list[bytes], slack: int) -> list[tuple[int, str, str]]:
    """Fingerprints of one chunk of non-empty texts. Only boundaries at most
    ``slack`` levels under a text's first block size are gathered; texts that
    need smaller ones are scanned again with all levels."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(_GAP + _GAP.join(texts) + _GAP, dtype=np.uint8)
    starts = WINDOW + np.concatenate(([0], np.cumsum(n + WINDOW)[:-1]))
    roll = _rolling(buf)
    top = _level(n)
    low = np.maximum(top - slack, 0)
    reach = np.repeat(((1 << low) - 1).astype(np.uint32), n + WINDOW)
    r1 = roll[WINDOW:] + np.uint32(1)
    hit = np.flatnonzero((r1 & reach) == 0)
    hit = hit[r1[hit] % np.uint32(3) == 0] + WINDOW
    owner = np.searchsorted(starts, hit, side="right") - 1
    inside = (hit < starts[owner] + n[owner])
    hit, owner = hit[inside], owner[inside]
    z = r1[hit - WINDOW].astype(np.uint64)
    level = np.bitwise_count((z & (~z + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    level[z == 0] = 32
    # number of boundaries of each text at each level or above
    table_ = np.zeros((len(texts), 66), dtype=np.int64)
    np.add.at(table_, (owner, level), 1)
    above = table_[:, ::-1].cumsum(1)[:, ::-1]
    k = top.copy()
    rows = np.arange(len(texts))
    for _ in range(64):
        short = (above[rows, np.minimum(k, 64)] + 1 < SIGNATURE // 2) & (k > low)
        if not short.any():
            break
        k[short] -= 1
    deeper = (above[rows, np.minimum(k, 64)] + 1 < SIGNATURE // 2) & (k > 0)
    # a chunk's hash: the sum of its bytes' mixed rolling hashes
    v = roll.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))
    out: list = [None] * len(texts)
    by_text = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if deeper[i]:
            out[i] = _scan([texts[i]], 64)[0]
            continue
        pos, lev = hit[by_text[i]:by_text[i + 1]], level[by_text[i]:by_text[i + 1]]
        s, e = int(starts[i]), int(starts[i] + n[i])
        sigs = []
        for kk, most in ((int(k[i]), SIGNATURE), (int(k[i]) + 1, SIGNATURE // 2)):
            cut = pos[lev >= kk][: most - 1] + 1
            edge = np.concatenate(([s], cut, [e] if not len(cut) or cut[-1] < e else []))
            edge = edge.astype(np.int64)
            h = (total[edge[1:]] - total[edge[:-1]]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            sigs.append(_CHARS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode())
        out[i] = (MIN_BLOCK << int(k[i]), sigs[0], sigs[1])
    return out


def fingerprint_batch(texts: list[bytes]) -> list[str]:
    """Fingerprints of UTF-8 texts; an empty text gives ``3::``."""
    out = [f"{MIN_BLOCK}::"] * len(texts)
    take: list[int] = []
    size = 0

    def flush():
        for i, (b, s1, s2) in zip(take, _scan([texts[i] for i in take], 2)):
            out[i] = f"{b}:{s1}:{s2}"
        take.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        if take and size + len(t) > _CHUNK:
            flush()
            size = 0
        take.append(i)
        size += len(t)
    if take:
        flush()
    return out


def _squeeze(s: str) -> str:
    """Runs of a character longer than three count as three."""
    out = []
    for c in s:
        if len(out) >= 3 and out[-1] == out[-2] == out[-3] == c:
            continue
        out.append(c)
    return "".join(out)


def edit_distance(s: str, t: str) -> int:
    """Insertions and deletions that turn ``s`` into ``t`` (a replacement is
    one of each): lengths less twice the longest common subsequence, computed
    bit-parallel."""
    at: dict[str, int] = {}
    for i, c in enumerate(s):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(s)) - 1
    row = full
    for c in t:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(s) + len(t) - 2 * (len(s) - row.bit_count())


def _alike(s: str, t: str) -> float:
    if not s or not t:
        return 0.0
    run = min(COMMON_RUN, len(s), len(t))
    if not any(s[i:i + run] in t for i in range(len(s) - run + 1)):
        return 0.0
    s, t = _squeeze(s), _squeeze(t)
    return 1.0 - edit_distance(s, t) / (len(s) + len(t))


def likeness(a: str, b: str) -> float:
    """0 to 1: equal fingerprints are 1; block sizes that are neither equal nor
    twice one another are 0; else the best of the signatures at a common block
    size."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2))
    if x == 2 * y:
        return _alike(a1, b2)
    if y == 2 * x:
        return _alike(a2, b1)
    return 0.0


def edited_text(text: str, nxt: str) -> str:
    """``text`` with its last third replaced by as many first code points of
    ``nxt`` (or all)."""
    k = len(text) // 3
    return text[:len(text) - k] + nxt[:k]


def _neighbours(docs: DataFrame, slices: int) -> tuple[DataFrame, int]:
    """Rows dealt to at most ``slices`` ranges (and how many there are) of descending doc_id, each followed by a
    copy (``ghost``) of the first row of the next range. Range bounds and the
    greatest id of each range are the only values on the driver; the texts move
    once."""
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)] or [0.5],
                                       10 * slices).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    below = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else \
        F.array().cast("array<bigint>")
    part = F.size(F.filter(below, lambda c: F.coalesce(c < F.col("doc_id"), F.lit(False))))
    docs = docs.withColumn("part", part)
    tops = {r["part"]: r["top"] for r in ids.withColumn("part", part).groupBy("part")
            .agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    n = len(cuts) + 1
    top = F.array(*[F.lit(tops.get(p)).cast("bigint") for p in range(n)])
    goes = F.array(*[F.lit(above.get(p, 0)) for p in range(n)])
    first = F.col("doc_id").eqNullSafe(F.element_at(top, F.col("part") + 1))
    to = F.when(first, F.array(
        F.struct(F.col("part").alias("slice"), F.lit(0).alias("ghost")),
        F.struct(F.element_at(goes, F.col("part") + 1).alias("slice"), F.lit(1).alias("ghost")),
    )).otherwise(F.array(F.struct(F.col("part").alias("slice"), F.lit(0).alias("ghost"))))
    return docs.withColumn("to", F.explode(to)).select("to.slice", "to.ghost", "doc_id", "text"), n


def _compare(batches):
    """Rows sorted by slice, rows before ghosts, descending id: each row is
    paired with the one that follows it; one pending row is held over."""
    pending = None  # (slice, doc_id, bytes) of a real row without its next

    def emit(rows):
        """rows: (doc_id, text, next text)"""
        texts = [a for _, a, _ in rows]
        edits = [edited_text(a, b) for _, a, b in rows]
        nexts = [b for _, _, b in rows]
        raw, raw_e = [t.encode() for t in texts], [t.encode() for t in edits]
        own, edit = fingerprint_batch(raw), fingerprint_batch(raw_e)
        # the next row's fingerprint is mostly that of the following row here
        nxt: list = [own[i + 1] if i + 1 < len(rows) and nexts[i] is texts[i + 1] else None
                     for i in range(len(rows))]
        rest = [i for i, x in enumerate(nxt) if x is None]
        for i, x in zip(rest, fingerprint_batch([nexts[i].encode() for i in rest])):
            nxt[i] = x
        return pa.record_batch([
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw_e]),
            pa.array(own), pa.array(edit),
            pa.array([likeness(a, b) for a, b in zip(own, edit)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, nxt)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                   "near_edited", "near_next"])

    for b in blocks(batches):
        slices, ghosts = b.column("slice").to_pylist(), b.column("ghost").to_pylist()
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        rows = []
        for s, g, i, t in zip(slices, ghosts, ids, texts):
            if pending is not None:
                rows.append((pending[0], pending[1], t))
                pending = None
            if not g:
                pending = (i, t)
        for at in range(0, len(rows), 512):
            yield emit(rows[at:at + 512])


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      slices: int | None = None) -> DataFrame:
    """One row per input row: its fingerprint, that of its edited text, and the
    likeness of its fingerprint to the edited text's and the next row's.

    The next row is the next in descending id (null ids last; after the last
    row the first; rows of one id are ordered by their text's hash). Null text
    is empty; an empty text has fingerprint ``3::``. An empty table gives no
    rows, a single row is its own next."""
    rows, n = _neighbours(keyed_text(docs, id_col, text_col),
                          slices or shuffle_width(docs.sparkSession))
    # one range a partition, by its number: hashing the number would pile some up
    return rows.repartitionById(n, F.col("slice")).sortWithinPartitions(
        F.col("slice"), F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")
    ).mapInArrow(_compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double")


def op1_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
