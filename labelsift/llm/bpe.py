"""BPE encoding and decoding with a transducer lexicon (operator 5).

The corpus's frequent pre-tokens are encoded once on the driver (at most
``LEXICON_WORDS``, a parameter) and compiled into a minimal acyclic transducer
(``lexicon.py``) that every Python worker maps from one file. A pre-token is
looked up there and, if it is no entry, merged exactly by the vocabulary's
merge ranks; the ids never depend on the lexicon. Decoding maps ids back to
bytes.

Frequencies are counted over all texts, in blocks: a block counts what stands
between spaces, cuts what it holds twice or more into pre-tokens and passes
their counts on, so a count is under by what stands once in a block.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, keyed_text, prepare, table, written
from labelsift.llm.lexicon import Lexicon, build
from labelsift.llm.pretoken import pretokens
from labelsift.operators.quantile import top_k
from labelsift.session import ensure_checkpoint_dir

LEXICON_WORDS = 100_000
LEXICON_BYTES = 64      # longer pre-tokens are merged, not listed
_BLOCK_WORDS = 400_000  # distinct pieces of a counting block
_MEMO_WORDS = 700_000   # words a worker remembers (about 160 MB)
_NONE = 1 << 62         # a pair without a merge


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, ids of single bytes, merges ``pair -> (rank, id)``,
    and the special strings that are cut out of a text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        # the ids of single bytes are themselves bytes in the public vocabularies
        self.first_ids = bytes(self.byte_id) if max(self.byte_id) < 256 else None
        self.merges = {}        # pair -> rank << 20 | id
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[(vocab[a] << 20) | vocab[b]] = (rank << 20) | vocab[a + b]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is merged, leftmost
        first, until no pair has a merge."""
        ids = list(word.translate(self.first_ids)) if self.first_ids else [self.byte_id[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        find = self.merges.get
        pairs = [find((a << 20) | b, _NONE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = find((ids[i - 1] << 20) | ids[i], _NONE)
            if i < len(pairs):
                pairs[i] = find((ids[i] << 20) | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list, for long ones."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                m = merges.get((ids[i] << 20) | ids[j])
                if m is not None:
                    heapq.heappush(heap, (m, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class _Memo(dict):
    """Ids (as bytes) of the pre-tokens met so far; bounded by the caller."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon and len(raw) <= LEXICON_BYTES else None
        if ids is None:
            merged = self.vocab.merge(raw)
            ids = struct.pack(f"<{len(merged)}I", *merged)
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None):
        self.vocab, self.memo = vocab, _Memo(vocab, lexicon)

    def _parts(self, text: str) -> list:
        """The text cut at special strings: texts, and ids of specials."""
        parts: list = [text]
        for s, i in self.vocab.special.items():
            if s in text:
                cut = []
                for p in parts:
                    if isinstance(p, str):
                        for k, x in enumerate(p.split(s)):
                            cut += [i] * (k > 0) + [x]
                    else:
                        cut.append(p)
                parts = cut
        return parts

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > _MEMO_WORDS:
            self.memo.clear()
        get = self.memo.__getitem__
        return b"".join([b"".join(map(get, pretokens(p))) if isinstance(p, str)
                         else struct.pack("<I", p) for p in self._parts(text)])

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.vocab.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return data.decode("utf-8", "replace")


def word_counts(rows: DataFrame, block_words: int = _BLOCK_WORDS) -> DataFrame:
    """``(word, n)`` of the pre-tokens of ``rows(text)``, the same under any
    partitioning. Texts are cut before every space first, since equal pieces
    are pre-tokenised once a block (three spaces in a row thus count as three
    single ones); words above ``LEXICON_BYTES`` are left out."""
    def run(batches):
        count: Counter = Counter()   # pieces that follow a space
        first: Counter = Counter()   # a text's first piece

        def passed_on():
            words: Counter = Counter()
            for pieces, space in ((count, " "), (first, "")):
                for piece, n in pieces.items():
                    for w in pretokens(space + piece):
                        words[w] += n
                pieces.clear()
            some = [(w, n) for w, n in words.items() if len(w) <= LEXICON_BYTES]
            for i in range(0, len(some), 50_000):
                w, n = zip(*some[i:i + 50_000])
                yield pa.record_batch([pa.array(w), pa.array(n, pa.int64())], names=["word", "n"])

        for b in blocks(batches):
            for t in b.column("text").to_pylist():
                head, *rest = t.split(" ")
                first[head] += 1
                count.update(rest)
                if len(count) + len(first) > block_words:
                    yield from passed_on()
        yield from passed_on()

    return rows.select("text").mapInArrow(run, "word string, n bigint") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(rows: DataFrame, vocab_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``rows(text)``; returns the name under
    which every worker finds the file. It is written to the shared checkpoint
    folder."""
    spark = rows.sparkSession
    # an exact threshold search instead of orderBy().limit(): the driver gets
    # the chosen words only, not every partition's candidates
    top = top_k(written(word_counts(rows), "words"), "n", words, "word").select("word").collect() \
        if words else []
    vocab = vocabulary(vocab_path)
    data = build({r["word"].encode(): struct.pack(f"<{len(ids)}I", *ids)
                  for r in top for ids in [vocab.merge(r["word"].encode())]})
    name = f"lexicon-{uuid.uuid4().hex}.lxn"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocab_path: str | None = None, words: int = LEXICON_WORDS,
           with_ids: bool = False) -> DataFrame:
    """One row per input row: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``
    and, on request, ``ids ARRAY<INT>`` and ``decoded``.

    Equal to the vocabulary's own library with its special strings recognised
    and none added. Null text is empty and has no ids; repeated rows are encoded
    each; an empty table gives no rows."""
    path = vocab_path or default_vocabulary()
    rows = keyed_text(docs, id_col, text_col)
    name = compile_lexicon(rows, path, words)

    def run(batches):
        codec = Codec(vocabulary(path), _lexicon(name))
        for b in blocks(batches):
            out = []
            for t in b.column("text").to_pylist():
                ids = codec.encode(t)
                text = codec.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                            hashlib.sha256(text.encode()).hexdigest(),
                            *([np.frombuffer(ids, dtype="<i4"), text] if with_ids else [])))
            cols = list(zip(*out)) or [()] * (5 if with_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.record_batch([b.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256",
                                         "ids", "decoded"][:1 + len(cols)])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))


def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode(table(spark, sf_dir, "documents"))
