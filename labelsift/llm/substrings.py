"""Removal of repeated substrings by bucket-pointer refinement (operator 4).

Every byte covered by a ``length``-byte string (400) that also starts anywhere
else in the corpus is removed. Sorting all suffixes would move every byte
position; here a *window* (a string of ``length`` bytes) is first put into the
bucket of one q-gram inside it, and buckets are refined on the buckets of later
offsets, only as long as they are shared:

1. *Initial q-gram buckets.* Each window picks its anchor, the leftmost least
   hashed position among its q-gram starts. The choice depends on the window's
   bytes alone, so equal windows pick the same anchor. Neighbouring windows
   share an anchor: a run of windows is one item ``(anchor, lo, hi)``, ``lo`` to
   ``hi`` being the offsets of the anchor in its windows; about 0.6 % of the
   byte positions are anchors. The anchor's q-gram is its first bucket.
2. *Bucket pointers.* ``identifiers`` gives every position its bucket at depth 8
   and refines it by the pair (own bucket, bucket at the later offset): depth
   doubles each time, and the refined identifiers are what the next doubling
   pairs. A string between two depths is the pair of the buckets at its start
   and at the offset where the last full depth begins.
3. *Refinement.* A block of offsets has a *core* (the bytes all its windows
   share: the bucket) and an *extent* (all bytes its windows cover). Equal
   extents within a bucket prove every window of the block repeated; a bucket
   with one member proves the rest unique. What is left in shared buckets is
   split into blocks of 64, 8 and 1 offsets, whose deeper cores refine the
   bucket; members with equal extents go on as one. At one offset core and
   extent are the window itself, so the answer is exact.

A bucket's identifier is a 64-bit number mixed from the pair instead of the
pair's rank among all: tasks agree on it without a global sort per doubling, and
a refinement is one aggregation (combined map-side). Cores and extents are named
by different constants, so a class, the pair of both, has 128 bits. Texts move
once for the members still open after step 1 and once to cut the spans out.

A text of any length is scanned in pieces of 256 KB that overlap by a run's
reach; a piece keeps the runs whose anchor is its own, so a run is never split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, keyed_text, prepare, table, written

LENGTH = 400
QGRAM = 64
STEPS = (64, 8, 1)
_CHUNK = 1 << 18
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# odd multipliers of the two families of identifiers
CORE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))
EXTENT = (np.uint64(0xA0761D6478BD642F), np.uint64(0xC4CEB9FE1A85EC53))
_POS_BITS = 34   # low bits of the ordering key: position in the scanned chunk


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one integer."""
    n = len(buf) - 7
    return np.ndarray((n,), dtype="<u8", buffer=buf, strides=(1,)).copy()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (block prefix and suffix
    minima)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, w)
    pre = np.minimum.accumulate(y, axis=1).ravel()
    suf = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1: n])


def anchors(texts: list[bytes], length: int = LENGTH, q: int = QGRAM):
    """Runs of windows of the texts (each at least ``length`` long): arrays
    (text, anchor position, lo, hi) with lo..hi the anchor's offsets."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(n)))
    buf = np.frombuffer(b"".join(texts) + b"\0" * 8, dtype=np.uint8)
    h = _words_at(buf)[: int(start[-1])]
    h *= _K1
    h ^= h >> np.uint64(32)
    h *= _K2
    h &= np.uint64(((1 << 64) - 1) ^ ((1 << _POS_BITS) - 1))
    h |= np.arange(len(h), dtype=np.uint64)
    least = _sliding_min(h, length - q + 1)
    at = (least & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    first = np.zeros(len(at) + 1, dtype=bool)     # a run starts here
    first[0] = True
    first[1:-1] = at[1:] != at[:-1]
    first[start[:-1]] = True
    last = n - length + start[:-1]                # last window start of a text
    first[last[:-1] + 1] = True
    begin = np.flatnonzero(first[:-1])
    owner = np.searchsorted(start, begin, side="right") - 1
    end = np.concatenate((begin[1:], [len(at)])) - 1
    valid = begin <= last[owner]
    begin, end, owner = begin[valid], end[valid], owner[valid]
    end = np.minimum(end, last[owner])
    a = at[begin]
    return owner, a - start[owner], a - end, a - begin


def _pair(own: np.ndarray, later: np.ndarray, family) -> np.ndarray:
    """The identifier of (own bucket, bucket at a later offset)."""
    x = own * family[0]
    x += later
    x ^= x >> np.uint64(29)
    x *= family[1]
    x ^= x >> np.uint64(32)
    return x


def identifiers(buf: np.ndarray, start: np.ndarray, size: np.ndarray, family, tag: np.ndarray) -> np.ndarray:
    """Identifiers of the strings ``buf[start:start + size]`` (8 bytes at least)
    that carry ``tag``: equal for equal strings and tags.

    All positions are refined from depth h to 2h by their bucket at offset h; a
    string of h to 2h - 1 bytes is the pair of the depth-h buckets at its start
    and at its last h bytes. ``buf`` ends with 8 bytes of padding."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    bucket = _words_at(buf)
    bucket *= family[0]
    bucket ^= bucket >> np.uint64(32)
    bucket *= family[1]
    bucket ^= bucket >> np.uint64(29)
    h, top = 8, int(size.max())
    while True:
        mine = np.flatnonzero((size >= h) & (size < 2 * h))
        at = start[mine]
        out[mine] = _pair(bucket[at], bucket[at + size[mine] - h], family)
        if 2 * h > top:
            break
        bucket = _pair(bucket[:-h], bucket[h:], family)
        h *= 2
    return _pair(out, (size.astype(np.uint64) << np.uint64(32)) | tag.astype(np.uint64), family)


_RUN = "doc_id bigint, text_hash bigint, pos int, lo smallint, hi smallint, core bigint, extent bigint"


def _pieces(text: bytes, length: int, q: int):
    """``(from, to, offset, bytes)``: the piece that owns the anchors from..to - 1
    holds every window of such an anchor."""
    reach, n = length - q, len(text)
    for a in range(0, n, _CHUNK):
        b = min(a + _CHUNK, n)
        off, end = max(a - reach, 0), min(b - 1 + length, n)
        if end - off >= length:
            yield a, b, off, text[off:end]


def _runs(length: int, q: int):
    def flush(rows):
        texts = [r[5] for r in rows]
        owner, pos, lo, hi = anchors(texts, length, q)
        low, up, off = (np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 3, 4))
        at = pos + off[owner]
        mine = (at >= low[owner]) & (at < up[owner])
        owner, pos, lo, hi, at = owner[mine], pos[mine], lo[mine], hi[mine], at[mine]
        start = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[owner] + pos
        buf = np.frombuffer(b"".join(texts) + b"\0" * 8, dtype=np.uint8)
        core = identifiers(buf, start, np.full(len(start), q), CORE, np.zeros(len(start)))
        extent = identifiers(buf, start - hi, hi - lo + length, EXTENT, lo)
        return pa.record_batch([
            pa.array(np.array([r[0] for r in rows], dtype=object)[owner], pa.int64()),
            pa.array(np.array([r[1] for r in rows], dtype=np.int64)[owner]),
            pa.array(at.astype(np.int32)), pa.array(lo.astype(np.int16)),
            pa.array(hi.astype(np.int16)), pa.array(core.view(np.int64)), pa.array(extent.view(np.int64))],
            names=["doc_id", "text_hash", "pos", "lo", "hi", "core", "extent"])

    def run(batches):
        for b in blocks(batches):
            rows, size = [], 0
            for r in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(),
                         b.column("text").to_pylist()):
                for piece in _pieces(r[2].encode(), length, q):
                    if rows and size + len(piece[3]) > _CHUNK:
                        yield flush(rows)
                        rows, size = [], 0
                    rows.append((r[0], r[1], *piece))
                    size += len(piece[3])
            if rows:
                yield flush(rows)
    return run


_CONTEXT = "doc_id bigint, text_hash bigint, pos int, lo smallint, hi smallint, open boolean, around binary"


def _contexts(length: int):
    """Rows (doc, its open runs) -> one row per run with the bytes its windows
    cover."""
    def run(batches):
        for b in blocks(batches):
            out, size = [], 0
            for i, h, t, runs in zip(*(b.column(c).to_pylist()
                                       for c in ("doc_id", "text_hash", "text", "runs"))):
                t = t.encode()
                for r in runs:
                    out.append((i, h, r["pos"], r["lo"], r["hi"], r["open"],
                                t[r["pos"] - r["hi"]:r["pos"] - r["lo"] + length]))
                    size += len(out[-1][-1])
                if size > 1 << 22:
                    yield _context_batch(out)
                    out, size = [], 0
            if out:
                yield _context_batch(out)
    return run


def _context_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                           names=["doc_id", "text_hash", "pos", "lo", "hi", "open", "around"])


_BLOCK = ("doc_id bigint, text_hash bigint, pos int, lo smallint, hi smallint, open boolean, "
          "core bigint, extent bigint")


def _blocks(length: int, step: int):
    """Rows with a context and a block (from, to) of offsets to split -> its
    aligned sub-blocks of ``step`` offsets, with core and extent."""
    def split(b):
        top, x, y = (b.column(c).to_numpy().astype(np.int64) for c in ("top", "lo", "hi"))
        # around[k] is the text's byte pos - top + k; the block needs around[top - y:top - x + length]
        parts = [a[t - v:t - u + length] for a, t, u, v in
                 zip(b.column("around").to_pylist(), top.tolist(), x.tolist(), y.tolist())]
        buf = np.frombuffer(b"".join(parts) + b"\0" * 8, dtype=np.uint8)
        base = np.cumsum([0] + [len(p) for p in parts[:-1]])
        first = x // step
        n = y // step - first + 1
        row = np.repeat(np.arange(len(n)), n)
        low = (first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
        u, v = np.maximum(low, x[row]), np.minimum(low + step - 1, y[row])
        # an offset o's window starts at base + y - o; windows of a whole block
        # share length - step + 1 bytes from its least offset's start
        zero = base[row] + y[row]
        core = identifiers(buf, zero - low, np.full(len(row), length - step + 1), CORE, low)
        extent = identifiers(buf, zero - v, v - u + length, EXTENT, u)
        kept = b.select(["doc_id", "text_hash", "pos", "open"]).take(pa.array(row))
        return pa.record_batch([kept.column(0), kept.column(1), kept.column(2), pa.array(u.astype(np.int16)),
                                pa.array(v.astype(np.int16)), kept.column(3),
                                pa.array(core.view(np.int64)), pa.array(extent.view(np.int64))],
                               names=["doc_id", "text_hash", "pos", "lo", "hi", "open", "core", "extent"])

    def run(batches):
        for b in blocks(batches, "around", _CHUNK):
            if b.num_rows:
                yield split(b)
    return run


def _refine(items: DataFrame, length: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One round over items ``(doc_id, text_hash, pos, lo, hi, open, core,
    extent)``, written. Returns the byte ranges now known to be repeated and
    the items to split: the open ones, and one member of every settled class,
    of buckets that hold at least two classes and an open item."""
    classes = items.groupBy("core", "extent").agg(
        F.count("*").alias("n"), F.max("open").alias("any_open"),
        F.min(F.struct("doc_id", "text_hash", "pos")).alias("rep"))
    if not last:
        classes = written(classes, "classes")
    repeated = classes.filter("n >= 2 and any_open").select("core", "extent")
    spans = items.filter("open").join(repeated, ["core", "extent"], "left_semi").select(
        "doc_id", "text_hash", (F.col("pos") - F.col("hi")).alias("s"),
        (F.col("pos") - F.col("lo") + length).alias("e"))
    if last:
        return spans, None
    buckets = classes.groupBy("core").agg(
        F.count("*").alias("classes"), F.max((F.col("n") == 1) & F.col("any_open")).alias("waits")) \
        .filter("classes >= 2 and waits").select("core")
    live = classes.join(buckets, "core", "left_semi").select("core", "extent", "n", "rep")
    go = items.join(live, ["core", "extent"]).filter(
        (F.col("n") == 1) | F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("rep")))
    return spans, go.select("doc_id", "text_hash", "pos", "lo", "hi",
                            (F.col("open") & (F.col("n") == 1)).alias("open"))


def _cut(batches):
    """Rows (doc_id, text, spans) -> lengths, counts, kept text."""
    for b in blocks(batches):
        out = []
        for i, t, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            t = t.encode()
            merged: list[list[int]] = []
            for r in sorted((r["s"], r["e"]) for r in spans or []):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, at = [], 0
            for s, e in merged:
                kept.append(t[at:s])
                at = e
            kept.append(t[at:])
            out.append((i, len(t), sum(e - s for s, e in merged), len(merged), b"".join(kept)))
            if len(out) >= 256:
                yield _cut_batch(out)
                out = []
        if out:
            yield _cut_batch(out)


def _cut_batch(rows):
    cols = list(zip(*rows))
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                            pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                            pa.array(cols[4], pa.binary())],
                           names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = QGRAM) -> DataFrame:
    """``docs(doc_id, text_hash, text)`` -> byte ranges ``(doc_id, text_hash,
    s, e)`` whose union is what is covered by repeated windows."""
    runs = written(docs.mapInArrow(_runs(length, q), _RUN), "runs")
    # step 1 keeps only ids in its aggregation: nearly all buckets have one member
    classes = written(runs.groupBy("core", "extent").agg(F.count("*").alias("n")), "classes")
    shared = classes.groupBy("core").agg(F.count("*").alias("classes"), F.sum("n").alias("total"),
                                         F.max(F.col("n") == 1).alias("waits")) \
        .filter("total >= 2").select("core", "classes", "waits")
    live = classes.join(shared, "core")
    members = written(runs.join(live, ["core", "extent"]), "members")
    spans = [members.filter("n >= 2").select(
        "doc_id", "text_hash", (F.col("pos") - F.col("hi")).alias("s"),
        (F.col("pos") - F.col("lo") + length).alias("e"))]
    go_on = members.filter("classes >= 2 and waits")
    single = go_on.filter("n = 1").select("doc_id", "text_hash", "pos", "lo", "hi",
                                          F.lit(True).alias("open"))
    rep = go_on.filter("n >= 2").groupBy("core", "extent").agg(
        F.min(F.struct("doc_id", "text_hash", "pos", "lo", "hi")).alias("r")) \
        .select("r.*", F.lit(False).alias("open"))
    per_doc = single.unionByName(rep).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("pos", "lo", "hi", "open")).alias("runs"))
    with_text = docs.join(per_doc.withColumnRenamed("doc_id", "r_id"),
                          F.col("r_id").eqNullSafe(F.col("doc_id"))
                          & (docs["text_hash"] == per_doc["text_hash"])) \
        .select("doc_id", docs["text_hash"], "text", "runs")
    # rows that repeat id and text would otherwise be joined with one another
    around = written(with_text.mapInArrow(_contexts(length), _CONTEXT)
                     .dropDuplicates(["doc_id", "text_hash", "pos"]), "contexts")
    ctx = around.select("doc_id", "text_hash", "pos", F.col("hi").alias("top"), "around")
    todo = around.select("doc_id", "text_hash", "pos", "lo", "hi", "open")
    for k, step in enumerate(STEPS):
        if k == 0:
            src = around.withColumn("top", F.col("hi"))
        else:
            t = todo.withColumnsRenamed({"doc_id": "t_id", "text_hash": "t_hash", "pos": "t_pos"})
            src = t.join(ctx,
                         F.col("t_id").eqNullSafe(F.col("doc_id"))
                         & (F.col("t_hash") == F.col("text_hash")) & (F.col("t_pos") == F.col("pos")))
        items = written(src.select("doc_id", "text_hash", "pos", "top", "open", "around", "lo", "hi")
                        .mapInArrow(_blocks(length, step), _BLOCK), f"blocks{step}")
        found, todo = _refine(items, length, last=step == STEPS[-1])
        spans.append(found)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, q: int = QGRAM) -> DataFrame:
    """One row per input row: ``(doc_id, n_bytes, n_removed, n_spans, kept
    BINARY)``.

    Texts are UTF-8 bytes (null: empty); windows never cross texts; texts
    shorter than ``length`` are kept whole. Rows that repeat a text repeat all
    its windows, whatever their ids (null included). An empty table gives no
    rows. A text of any length is scanned in overlapping pieces. Only the two
    named columns are read, so other columns cannot clash."""
    if not 8 <= q <= length - max(STEPS) + 1:
        raise ValueError("a q-gram has at least 8 bytes and fits the smallest core")
    if length > 32_767:
        raise ValueError("offsets inside a string are 16-bit numbers: at most 32,767 bytes")
    rows = keyed_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(rows, length, q).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("s", "e")).alias("spans")) \
        .withColumnsRenamed({"doc_id": "s_id", "text_hash": "s_hash"})
    joined = rows.join(spans, F.col("s_id").eqNullSafe(F.col("doc_id"))
                       & (F.col("s_hash") == F.col("text_hash")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op4_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))
