"""Token counts by trie-shared dynamic programming (operator 9).

A unigram model over a public byte vocabulary (probability by Zipf's law on the
vocabulary's rank; single bytes share the last rank, so every text has a
segmentation) gives each pre-token its most probable segmentation. Distinct
pre-tokens are inserted in a trie; a node holds the forward score of its prefix
and the number of tokens of that score's path, computed once from the nodes
above it, so words that share a prefix share its work. A pre-token's count is
the value stored at its terminal node.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from labelsift.llm.common import blocks, keyed_text, prepare, table
from labelsift.llm.pretoken import pretokens

MAX_NODES = 400_000     # a worker's trie starts afresh beyond these
MAX_WORDS = 300_000     # as does its memo of whole pre-tokens
TRIE_BYTES = 256        # longer pre-tokens are computed without storing nodes


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def scores(path: str) -> tuple[dict[bytes, float], int]:
    """Log-probability of every piece, and the longest piece's length."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    n = len(ranks)
    norm = math.log(sum(1.0 / r for r in range(1, n + 1)))
    order = sorted((r, p) for p, r in ranks.items() if len(p) > 1)
    out = {p: -math.log(k + 1) - norm for k, (_, p) in enumerate(order)}
    out.update({bytes([b]): -math.log(n) - norm for b in range(256)})
    return out, max(map(len, out))


def _step(word: bytes, end: int, best, count, piece_score: dict, longest: int) -> tuple[float, int]:
    """Forward score and token count of ``word[:end]`` from those of its
    prefixes (``best[i]``, ``count[i]``). Equal scores: fewer tokens."""
    top, n = -math.inf, 0
    for start in range(max(0, end - longest), end):
        s = piece_score.get(word[start:end])
        if s is not None:
            v, k = best[start] + s, count[start] + 1
            if v > top or (v == top and k < n):
                top, n = v, k
    return top, n


class TrieCounter:
    """Token counts of pre-tokens, one worker's."""

    def __init__(self, path: str):
        self.piece_score, self.longest = scores(path)
        self.memo: dict[str, tuple[int, float]] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def of(self, word: bytes) -> tuple[int, float]:
        if len(word) > TRIE_BYTES:
            best, count = [0.0], [0]
            for end in range(1, len(word) + 1):
                # only the last pieces' reach is looked back upon
                v, k = _step(word, end, best, count, self.piece_score, self.longest)
                best.append(v)
                count.append(k)
            return count[-1], best[-1]
        if len(self.best) > MAX_NODES:
            self._fresh()
        child, best, count = self.child, self.best, self.count
        node, path_best, path_count = 0, [0.0], [0]
        for end, b in enumerate(word, 1):
            key = node << 8 | b
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(best)
                v, k = _step(word, end, path_best, path_count, self.piece_score, self.longest)
                best.append(v)
                count.append(k)
            node = nxt
            path_best.append(best[node])
            path_count.append(count[node])
        return count[node], best[node]

    def text(self, text: str) -> tuple[int, int, float]:
        """Pre-tokens, tokens and log-score of a whole text."""
        if len(self.memo) > MAX_WORDS:
            self.memo.clear()
        memo, n, total = self.memo, 0, 0.0
        words = pretokens(text)
        for w in words:
            r = memo.get(w)
            if r is None:
                r = memo[w] = self.of(w.encode())
            n += r[0]
            total += r[1]
        return len(words), n, total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocab_path: str | None = None) -> DataFrame:
    """One row per input row: ``(doc_id, n_pretokens, n_tokens, log_score)``.
    Null text is empty: no tokens, score 0. Repeated rows are counted each; an
    empty table gives no rows."""
    path = vocab_path or default_vocabulary()

    def run(batches):
        counter = TrieCounter(path)
        for b in blocks(batches):
            cols = list(zip(*[counter.text(t) for t in b.column("text").to_pylist()])) or [()] * 3
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.float64())],
                names=["doc_id", "n_pretokens", "n_tokens", "log_score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, log_score double")


def op9_trie_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts(table(spark, sf_dir, "documents"))
