"""Minimal acyclic transducer: words to id sequences in one flat file.

The automaton is built from the sorted words, sharing prefixes and suffixes; a
transition carries the number of words that sort before it, so the sum along a
word's path is the word's rank, and the rank finds its ids in a flat table.
States and transitions are arrays of one file, read through ``mmap``: the
Python workers of a machine share its pages.
"""

from __future__ import annotations

import mmap
import struct
from array import array

_MAGIC = b"LXN1"


class _State:
    __slots__ = ("edges", "final", "count", "number")

    def __init__(self):
        self.edges: list[tuple[int, _State]] = []
        self.final = False
        self.count = 0
        self.number = -1

    def key(self):
        return self.final, tuple((b, id(s)) for b, s in self.edges)


def build(entries: dict[bytes, bytes]) -> bytes:
    """File of ``word -> ids`` (ids as little-endian unsigned 32-bit bytes)."""
    words = sorted(entries)
    root = _State()
    register: dict = {}
    path: list[_State] = [root]
    last = b""

    def settle(depth: int) -> None:
        """Replace the states below ``depth`` on the path by equal known ones."""
        while len(path) > depth + 1:
            state = path.pop()
            known = register.setdefault(state.key(), state)
            if known is not state:
                parent = path[-1]
                parent.edges[-1] = (parent.edges[-1][0], known)

    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        settle(same)
        for b in w[same:]:
            nxt = _State()
            path[-1].edges.append((b, nxt))
            path.append(nxt)
        path[-1].final = True
        last = w
    settle(0)
    # number the states, children first, and count the words below each
    order: list[_State] = []
    stack = [(root, False)]
    while stack:
        s, done = stack.pop()
        if done:
            if s.number < 0:
                s.number = len(order)
                s.count = s.final + sum(t.count for _, t in s.edges)
                order.append(s)
        elif s.number < 0:
            stack.append((s, True))
            stack += [(t, False) for _, t in s.edges if t.number < 0]
    first, final = array("I"), array("I")
    label, target, before = bytearray(), array("I"), array("I")
    for s in order:
        first.append(len(label))
        final.append(int(s.final))
        n = int(s.final)
        for b, t in s.edges:
            label.append(b)
            target.append(t.number)
            before.append(n)
            n += t.count
    first.append(len(label))
    ids, at = array("I", [0]), 0
    for w in words:
        at += len(entries[w]) // 4
        ids.append(at)
    head = struct.pack("<4s5I", _MAGIC, len(order), len(label), len(words), root.number, at)
    return head + b"".join(a.tobytes() for a in (first, final, target, before, ids)) + \
        b"".join(entries[w] for w in words) + bytes(label)


class Lexicon:
    """Look-ups in a file made by ``build``, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        magic, states, edges, words, self.root, n = struct.unpack("<4s5I", view[:24])
        if magic != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at = 24
        parts = []
        for size in (states + 1, states, edges, edges, words + 1):
            parts.append(view[at:at + 4 * size].cast("I"))
            at += 4 * size
        self.first, self.final, self.target, self.before, self.ids = parts
        self.flat = view[at:at + 4 * n]
        self.labels = at + 4 * n            # where the transitions' bytes start
        self.states, self.words = states, words

    def get(self, word: bytes) -> bytes | None:
        """Ids of ``word``, or None if it is no entry."""
        state, rank, labels = self.root, 0, self.labels
        first, target, before, find = self.first, self.target, self.before, self._map.find
        for i in range(len(word)):
            at = find(word[i:i + 1], labels + first[state], labels + first[state + 1])
            if at < 0:
                return None
            at -= labels
            rank += before[at]
            state = target[at]
        if not self.final[state]:
            return None
        return bytes(self.flat[4 * self.ids[rank]:4 * self.ids[rank + 1]])
