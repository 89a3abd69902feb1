"""SimHash near-duplicates by a byte-position inverted index with count
filtering (operator 7).

A fingerprint is eight positional bytes. Two fingerprints that differ in at
most ``max_bits`` (four) bits differ in at most four bytes, so they share at
least four positional bytes: the guaranteed minimum of the count filter. A
posting list per single ``(position, byte)`` would hold 1/256 of the corpus,
and tallying pairs inside such lists is quadratic; the index is therefore kept
on *sets of four* positional bytes (70 sets). A pair's tally of shared
positional bytes reaches the minimum exactly if the pair meets in at least one
such list, so a list is short unless its members really are alike. Pairs that
meet are tallied and verified on the bit distance.

Groups: equal fingerprints are one entry. A list emits a spanning forest of
its links, never all pairs. Lists above ``LIST_LIMIT`` entries are indexed once
more on four of the eight nibbles of their free bytes (the same pigeonhole),
after which only 16 bits are free: at most 65,536 distinct fingerprints a list,
whatever the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsift.llm.common import (
    blocks, keyed_text, packed, prepare, row_key, shuffle_width, table, written)
from labelsift.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
LIST_LIMIT = 20_000
_SETS = list(combinations(range(8), 4))


def simhash64(text: str, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """SimHash of the word shingles of ``text``: A-Z lower-cased, words split
    on ASCII white space, repeats counted; fewer words than a shingle make one
    shingle, no words fingerprint zero. A bit is set if over half of the
    shingle hashes have it."""
    import xxhash

    parts = text.encode("utf-8").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    a, b = starts[: len(parts) - words + 1].tolist(), (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], seed) for i, j in zip(a, b)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i: i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> DataFrame:
    """``(doc_id, text_hash, fp BIGINT)``, one row per input row."""
    def run(batches):
        for b in blocks(batches):
            fps = [simhash64(t, words, seed) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("text_hash"),
                 pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "text_hash", "fp"])

    rows = keyed_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _index(batches):
    """Postings: one row per fingerprint and set of four positional bytes."""
    for b in batches:
        fp = np.asarray(b.column("fp")).view(np.uint64)
        parts = [(fp >> np.uint64(8 * i)) & np.uint64(255) for i in range(8)]
        keys = np.concatenate([
            (np.uint64(c) << np.uint64(32)) | (parts[p[0]] << np.uint64(24))
            | (parts[p[1]] << np.uint64(16)) | (parts[p[2]] << np.uint64(8)) | parts[p[3]]
            for c, p in enumerate(_SETS)])
        yield pa.record_batch([pa.array(keys.view(np.int64)),
                               pa.array(np.tile(fp.view(np.int64), len(_SETS)))],
                              names=["key", "fp"])


def _reindex(batches):
    """Postings of an over-long list: its set and bytes, and four of the eight
    nibbles of its free bytes (62 bits in all)."""
    for b in batches:
        key = np.asarray(b.column("key")).view(np.uint64)
        fp = np.asarray(b.column("fp")).view(np.uint64)
        c = (key >> np.uint64(32)).astype(np.int64)
        free = np.array([[i for i in range(8) if i not in s] for s in _SETS])[c]
        nib = []
        for j in range(4):
            byte = (fp >> (8 * free[:, j]).astype(np.uint64)) & np.uint64(255)
            nib += [byte & np.uint64(15), byte >> np.uint64(4)]
        fixed = key & np.uint64(0xFFFFFFFF)
        keys = np.concatenate([
            (np.uint64(d) << np.uint64(55)) | (c.astype(np.uint64) << np.uint64(48))
            | (fixed << np.uint64(16)) | (nib[p[0]] << np.uint64(12)) | (nib[p[1]] << np.uint64(8))
            | (nib[p[2]] << np.uint64(4)) | nib[p[3]] for d, p in enumerate(_SETS)])
        yield pa.record_batch([pa.array(keys.view(np.int64)),
                               pa.array(np.tile(fp.view(np.int64), len(_SETS)))],
                              names=["key", "fp"])


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally: positional bytes that two fingerprints share."""
    x = np.ascontiguousarray(a ^ b).view(np.uint8).reshape(-1, 8)
    return (x == 0).sum(1)


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among ``fps`` (one list, bounded): breadth
    first, each newly reached fingerprint linked to the one that reached it."""
    left, out_a, out_b = fps, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            nxt = []
            for f in front:
                d = left ^ f
                near = (np.bitwise_count(d) <= max_bits)
                near &= shared_bytes(left, np.broadcast_to(f, left.shape)) >= 8 - max_bits
                if near.any():
                    hit = left[near]
                    out_a.append(np.full(len(hit), f, dtype=np.uint64))
                    out_b.append(hit)
                    nxt.append(hit)
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(nxt) if nxt else left[:0]
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _links(max_bits: int, limit: int | None):
    """Over rows sorted by key: links of each posting list as ``(0, a, b)``;
    a list longer than ``limit`` is passed on as ``(1, key, fp)`` rows, so no
    more than ``limit`` entries of a list are held."""
    def run(batches):
        keep_k = keep_f = np.empty(0, dtype=np.uint64)
        over = None  # key of the list that is being passed on

        def rows(kind, a, b):
            return pa.record_batch([pa.array(np.full(len(a), kind, dtype=np.int32)),
                                    pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                   names=["kind", "a", "b"])

        def close(k, f):
            """Whole lists only."""
            if len(k) < 2:
                return
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            start = np.concatenate(([0], cut))
            size = np.diff(np.concatenate((start, [len(k)])))
            two = start[size == 2]
            a, b = [f[two]], [f[two + 1]]
            near = np.bitwise_count(a[0] ^ b[0]) <= max_bits
            near &= shared_bytes(a[0], b[0]) >= 8 - max_bits
            a[0], b[0] = a[0][near], b[0][near]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                if limit and n > limit:
                    yield rows(1, k[s:s + n], f[s:s + n])
                    continue
                x, y = _forest(f[s:s + n], max_bits)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield rows(0, np.minimum(a, b), np.maximum(a, b))

        for batch in batches:
            k = np.concatenate((keep_k, np.asarray(batch.column("key")).view(np.uint64)))
            f = np.concatenate((keep_f, np.asarray(batch.column("fp")).view(np.uint64)))
            if over is not None:
                n = int(np.argmax(k != over)) if (k != over).any() else len(k)
                if n:
                    yield rows(1, k[:n], f[:n])
                k, f = k[n:], f[n:]
                if len(k):
                    over = None
            if not len(k):
                keep_k, keep_f = k, f
                continue
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            yield from close(k[:last], f[:last])
            keep_k, keep_f = k[last:], f[last:]
            if limit and len(keep_k) > limit:
                yield rows(1, keep_k, keep_f)
                over = keep_k[0]
                keep_k = keep_f = keep_k[:0]
        yield from close(keep_k, keep_f)
    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``fps(fp)``, distinct -> ``(a, b)``: verified links whose components
    are those of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index on four positional bytes is exact for at most 4 bits")
    n = shuffle_width(fps.sparkSession)

    def lists(rows: DataFrame, limit):
        return rows.repartition(n, "key").sortWithinPartitions("key") \
            .mapInArrow(_links(max_bits, limit), "kind int, a bigint, b bigint")

    first = written(lists(fps.select("fp").mapInArrow(_index, "key bigint, fp bigint"),
                          list_limit).distinct(), "links")
    links = first.filter("kind = 0").select("a", "b")
    rest = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if rest.isEmpty():
        return links
    again = lists(rest.mapInArrow(_reindex, "key bigint, fp bigint"), None)
    return links.unionByName(again.select("a", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``(doc_id, text_hash, fp, root, component_id)``.

    ``root`` names the component (its least fingerprint), ``component_id`` is
    the least doc_id reachable over links of at most ``max_bits`` differing
    bits. Null text counts as empty; empty texts have fingerprint zero and link
    like any other. Null ids are ignored by the minimum, so a component of null
    ids only has a null component_id. Repeated rows are one fingerprint each;
    an empty table gives no rows."""
    fps = written(fingerprints(docs, id_col, text_col, words), "fps")
    entry = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "entries")
    roots = components(near_links(entry, max_bits)).withColumnRenamed("node", "fp")
    rooted = written(entry.join(roots, "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    # written, as a join splits a hot root only where its other side is no aggregation
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one_per_component(docs: DataFrame, words: int = SHINGLE_WORDS,
                           max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row per component: the one with the least doc_id
    (nulls last), ties by the text's hash; all columns stay. Rows that repeat
    both id and text are one row. The texts are shuffled once; the choice is
    made on ids and fingerprints."""
    near = near_duplicates(docs, words=words, max_bits=max_bits)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("i"),
                     F.col("text_hash").alias("h"))
    best = near.groupBy("root").agg(F.min(order).alias("w")) \
        .select(*row_key(F.col("w.i"), F.col("w.h")))
    same = Window.partitionBy("key_id", "key_hash").orderBy("key_id")
    return packed(docs).join(best, ["key_id", "key_hash"]) \
        .withColumn("nth", F.row_number().over(same)).filter("nth = 1").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")
