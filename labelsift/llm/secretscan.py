"""Secret scans with a recursive decoding worklist (operator 8).

A text is scanned as it stands, then every encoded layer in it: percent escapes
(in form-encoded words ``+`` is a space as well) and Unicode escapes (the text
with all of them decoded is a new layer, mapped piecewise), runs of base64, also
those wrapped into (indented) lines or behind a part of a path, and gzip or zlib
streams, inside base64 or written with ``%xx`` or ``\\xNN`` (a decoded run is a new
layer, all of it mapped to the run). Bytes are the unit of a decoded run: those
that are no clean UTF-8 are read as UTF-8 with control characters, UTF-16 or
Latin-1, where they hold anything that could be a secret or a further layer. Each new layer is scanned and
unwrapped again until nothing new appears. A layer that repeats a content
already seen for the same place is not followed, which ends cycles. Spans are
code point offsets of the original text.

``MAX_DECODED`` bounds what inflating may add to one text (decompression
bombs); nothing else is charged to it. A stream beyond it is unpacked up to the
bound and the rest of the worklist goes on; ``truncated`` tells where it acted,
and ``redacted`` replaces the whole run of such a stream.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, keyed_text, prepare, table

KINDS = ("assign", "access", "hex")
MAX_DECODED = 1 << 26
PLACEHOLDER = "[SECRET]"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_UNIT = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++={0,2})+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_CUT = re.compile("[/_-]")
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
# Unreadable bytes are worth another reading only if they hold one of these.
_INTEREST = re.compile(rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]")
_FORM = re.compile(r"(?:%[0-9A-Fa-f]{2}|\+)+")
_CHUNK = re.compile(r"\S+")
# Streams written byte by byte: where one may start, and the units it goes on with.
_PERCENT_STREAM = re.compile(r"%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA])")
_PERCENT_UNIT = re.compile(r"%([0-9A-Fa-f]{2})|([A-Za-z0-9_.~!*'()/+-])")
_HEX_STREAM = re.compile(r"\\x1[fF]\\x8[bB]|(?:\\x78|x)\\x(?:01|5[eE]|9[cC]|[dD][aA])")
_HEX_UNIT = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([nrtabfv0\\'\"])|([\x20-\x5b\x5d-\x7e])")
_ESCAPES = {"n": 10, "r": 13, "t": 9, "a": 7, "b": 8, "f": 12, "v": 11, "0": 0, "\\": 92, "'": 39, '"': 34}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base rules: per kind leftmost, not
    overlapping, matches that are too short dropped. (For access and hex a
    minimum in the pattern is the same thing: the longest run starts first.)"""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text)
                if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


class _Layer:
    """A decoded text and where its characters come from: either one span for
    all of it, or pieces ``(start here, start there, copied)``, in order, of
    the parent layer."""

    def __init__(self, text: str, parent: "_Layer | None" = None, whole=None, pieces=None, size=0):
        self.text, self.parent, self.whole, self.pieces, self.size = text, parent, whole, pieces, size
        self.at = [p[0] for p in pieces] if pieces else None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Span of the original text behind ``start:end`` here."""
        layer = self
        while layer.parent is not None:        # layers can be nested thousands deep
            start, end = layer.whole or (layer._back(start, 0), layer._back(end - 1, 1))
            layer = layer.parent
        return start, end

    def _back(self, i: int, after: int) -> int:
        k = bisect_right(self.at, i) - 1
        here, there, copied = self.pieces[k]
        if copied:
            return there + (i - here) + after
        # a decoded escape run: its own span, not one escape's share of it
        return self.pieces[k + 1][1] if after and k + 1 < len(self.pieces) else (
            self.size if after else there)


def _replaced(layer: _Layer, pattern: re.Pattern, decode, where=None) -> _Layer | None:
    """The layer with all matches decoded (those that start ``where`` allows),
    or None without any change."""
    text, parts, pieces, at, size = layer.text, [], [], 0, 0
    for m in pattern.finditer(text):
        if where and not where(m.start()):
            continue
        new = decode(m.group())
        if new is None or new == m.group():
            continue
        if m.start() > at:
            pieces.append((size, at, True))
            parts.append(text[at:m.start()])
            size += m.start() - at
        if new:
            pieces.append((size, m.start(), False))
            parts.append(new)
            size += len(new)
        at = m.end()
    if not parts:
        return None
    if at < len(text):
        pieces.append((size, at, True))
        parts.append(text[at:])
    return _Layer("".join(parts), layer, pieces=pieces, size=at)


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _form(run: str) -> str:
    return _percent(run.replace("+", "%20"))


def _form_layer(layer: _Layer) -> _Layer | None:
    """The layer with ``+`` and percent escapes decoded in the words that hold
    both (form-encoded text has no white space)."""
    words = [(m.start(), m.end()) for m in _CHUNK.finditer(layer.text) if "+" in m.group() and _PERCENT.search(m.group())]
    if not words:
        return None
    starts = [a for a, _ in words]

    def inside(i):
        k = bisect_right(starts, i) - 1
        return k >= 0 and i < words[k][1]
    return _replaced(layer, _FORM, _form, inside)


def _written_streams(text: str):
    """``(start, units, bytes)`` of streams written byte by byte: ``units`` holds
    the end of every byte's unit."""
    for first, unit in ((_PERCENT_STREAM, _PERCENT_UNIT), (_HEX_STREAM, _HEX_UNIT)):
        data, ends, index, stop = bytearray(), [], {}, 0
        for m in first.finditer(text):
            if m.start() not in index:
                if m.start() < stop:
                    continue                # inside a unit of the run before
                data, ends, index, at = bytearray(), [], {}, m.start()
                while u := unit.match(text, at):    # a run is read once for all starts in it
                    index[at] = len(data)
                    hexed, *plain = u.groups()
                    data.append(int(hexed, 16) if hexed else _ESCAPES[plain[0]] if len(plain) > 1 and plain[0]
                                else ord(plain[-1]))
                    at = u.end()
                    ends.append(at)
                stop = at
            k = index[m.start()]
            if _is_stream(data[k:k + 3]) and _opens(data[k:k + 1024]):
                yield m.start(), ends[k:], bytes(data[k:])


def _opens(head: bytes) -> bool:
    """Whether a stream's first bytes unpack."""
    try:
        zlib.decompressobj(47).decompress(head, 64)
    except zlib.error:
        return False
    return True


def _stream_end(data: bytes) -> int:
    """Bytes of the first stream in ``data`` (all of them if it does not end)."""
    d = zlib.decompressobj(47)
    at = 0
    try:
        while at < len(data) and not d.eof:
            d.decompress(data[at:at + 65536], 1 << 16)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 16)
            at += 65536
    except zlib.error:
        return len(data)
    return min(len(data), at) - len(d.unused_data) if d.eof else len(data)


def _unicode(run: str) -> str | None:
    codes = [int(a or b, 16) for a, b in _UNIT.findall(run)]
    if any(c > 0x10FFFF for c in codes):
        return None
    text = "".join(map(chr, codes))
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _is_stream(data) -> bool:
    """Whether bytes start like a gzip or zlib stream."""
    return data[:2] == b"\x1f\x8b" or (
        len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def _inflate(data: bytes, room: int) -> tuple[bytes | None, bool]:
    """A gzip or zlib stream and those that follow it, unpacked (at most
    ``room`` bytes); None if it is neither."""
    parts, over = [], False
    while room > 0 and _is_stream(data):
        d = zlib.decompressobj(47)
        try:
            parts.append(d.decompress(data, room))
        except zlib.error:
            break
        room -= len(parts[-1])
        over = bool(d.unconsumed_tail) or (room <= 0 and (not d.eof or _is_stream(d.unused_data)))
        data = d.unused_data
    return (b"".join(parts), over) if parts else (None, False)


def _readable(data: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 without control characters other than
    white space."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _readings(data: bytes) -> list[str]:
    """The texts that bytes may be: clean UTF-8, else what their control
    characters, UTF-16 or Latin-1 leave to scan."""
    text = _readable(data)
    if text is not None:
        return [text]
    out = []
    zeros = data.count(0)
    if zeros * 4 >= len(data) and _INTEREST.search(data.replace(b"\0", b"")):
        big = data[:2] == b"\xfe\xff" or (data[:2] != b"\xff\xfe" and data[::2].count(0) > data[1::2].count(0))
        out.append(data.decode("utf-16-be" if big else "utf-16-le", "replace"))
    if _INTEREST.search(data):
        try:
            out.append(data.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(data.decode("latin-1"))
    return out


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _wrapped(text: str):
    """Spans of base64 broken into lines: runs of equal length one line break
    apart, with and without the shorter run that may follow them."""
    for m in _WRAPPED.finditer(text):
        lines = list(_LINE.finditer(text, m.start(), m.end()))
        at = 0
        while at < len(lines) - 1:
            width, end = len(lines[at].group()), at + 1
            while end < len(lines) and len(lines[end].group()) == width:
                end += 1
            if width >= 16:
                if end < len(lines) and len(lines[end].group()) < width:
                    yield lines[at].start(), lines[end].end()
                if end - at > 1:
                    yield lines[at].start(), lines[end - 1].end()
            at = end


def _parts(run: str):
    """``(start, end, bytes)`` inside a run that is not base64 as a whole: the
    stretches between two of its '/', '-' and '_' that are readable, and what
    starts like a stream. Boundaries a multiple of four apart share one decoding."""
    run = run.rstrip("=")
    cuts = [m.start() for m in _CUT.finditer(run)]
    ends = [*cuts, len(run)]
    for turn in range(4):
        starts = [c for c in [0] + [c + 1 for c in cuts] if c % 4 == turn and len(run) - c >= 16]
        if not starts:
            continue
        tail = run[turn:]
        data = memoryview(_decoded(tail[:-1] if len(tail) % 4 == 1 else tail) or b"")
        bad = [m.start() for m in _CONTROL.finditer(data)] + [len(data)]
        done = 0
        for s in starts:
            at = (s - turn) // 4 * 3
            if _is_stream(data[at:at + 3]):
                yield s, len(run), bytes(data[at:])
            if at < done:
                continue
            stop = bad[bisect_left(bad, at)]
            try:
                codecs.utf_8_decode(data[at:stop], "strict", True)
            except UnicodeDecodeError as e:
                stop = at + e.start
            done = stop
            # the last boundary up to which all is readable
            k = bisect_right(ends, len(run) if stop == len(data) else turn + stop * 4 // 3) - 1
            if k >= 0 and ends[k] - s >= 16:
                part = _decoded(run[s:ends[k] - ((ends[k] - s) % 4 == 1)])
                if part:
                    yield s, ends[k], part


def _base64_runs(text: str):
    """``(start, end, bytes)`` of base64 in a text: unbroken runs, wrapped ones
    and, of runs that give no text, their parts."""
    for m in _BASE64.finditer(text):
        data = _decoded(m.group())
        if data is not None:
            yield m.start(), m.end(), data
        if (data is None or not (_is_stream(data) or _readable(data))) and _CUT.search(m.group()):
            for s, e, part in _parts(m.group()):
                yield m.start() + s, m.start() + e, part
    for s, e in _wrapped(text):
        data = _decoded(re.sub("[\r\n\x20\t]", "", text[s:e]))
        if data is not None:
            yield s, e, data


def _base64_layers(layer: _Layer, room: int):
    """Layers inside base64 runs and written streams; yields (layer or None,
    start, end, bytes gained by inflating, truncated)."""
    streams = ((s, ends[_stream_end(data) - 1], data) for s, ends, data in _written_streams(layer.text)) \
        if "%" in layer.text or "\\x" in layer.text else ()
    for start, end, data in chain(_base64_runs(layer.text), streams):
        seen, cut, gained = set(), False, 0
        while True:              # compressed layers, one inside the other
            mark = hashlib.sha1(data).digest()
            if mark in seen:
                break
            seen.add(mark)
            more, over = _inflate(data, len(data) + max(room, 0))
            if more is None:
                break
            gain = max(0, len(more) - len(data))
            room -= gain
            gained += gain
            cut |= over
            data = more
        texts = _readings(data)
        for i, text in enumerate(texts or [None]):
            if text is not None or cut or gained:
                yield (None if text is None else _Layer(text, layer, whole=(start, end)), start, end,
                       0 if i else gained, cut)


def _unfold(text: str) -> tuple[list, list, int, list]:
    """Base spans, all spans (both sorted by start, then kind), number of
    layers unfolded, and the spans of streams the guard cut."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(base_spans(text), key=lambda s: (s[0], order[s[1]]))
    found, n, refused = set(base), 0, set()
    work, seen, room = [_Layer(text)], set(), MAX_DECODED
    while work:
        layer = work.pop()
        new = []
        if "%" in layer.text:
            new.append(_replaced(layer, _PERCENT, _percent))
            if "+" in layer.text:
                new.append(_form_layer(layer))
        if "\\" in layer.text:
            new.append(_replaced(layer, _UNICODE, _unicode))
        for inner, start, end, gained, over in _base64_layers(layer, room):
            room -= gained
            if over:
                refused.add(layer.origin(start, end))
            new.append(inner)
        for inner in new:
            if inner is None:
                continue
            mark = (hashlib.sha1(inner.text.encode("utf-8", "surrogatepass")).digest(),
                    inner.origin(0, max(1, len(inner.text))))
            if mark in seen:
                continue
            seen.add(mark)
            n += 1
            for s, kind, e in base_spans(inner.text):
                s, e = inner.origin(s, e)
                found.add((s, kind, e))
            work.append(inner)
    return base, sorted(found, key=lambda s: (s[0], order[s[1]], s[2])), n, sorted(refused)


def scan_text(text: str) -> tuple[list, list, int, bool]:
    """Base spans, all spans (both sorted by start, then kind), number of
    layers unfolded, and whether the guard cut one."""
    base, every, n, refused = _unfold(text)
    return base, every, n, bool(refused)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(doc_id, n_assign, n_access, n_hex, base, spans,
    n_layers, truncated)``; ``base`` and ``spans`` are ``kind:start:end`` lists.
    Null text is empty and has no spans; repeated rows are scanned each; an
    empty table gives no rows."""
    def run(batches):
        for b in blocks(batches):
            rows = []
            for t in b.column("text").to_pylist():
                base, every, n, cut = scan_text(t)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), _joined(base), _joined(every), n, cut))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.record_batch(
                [b.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, (
                    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_layers", "truncated"])

    return keyed_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, "
             "spans string, n_layers int, truncated boolean")


def redacted(text: str) -> str:
    """``text`` with every span, and every run that unfolds to more than the
    guard allows (overlaps merged), replaced by a placeholder."""
    _, every, _, refused = _unfold(text)
    merged: list[list[int]] = []
    for s, e in sorted([(s, e) for s, _, e in every] + refused):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    parts, at = [], 0
    for s, e in merged:
        parts += [text[at:s], PLACEHOLDER]
        at = e
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars`` brought up to
    date where there is such a column); null texts stay null, every row stays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in blocks(batches):
            old = b.column("text").to_pylist()
            new = [None if t is None else redacted(t) for t in old]
            cols = list(b.columns)
            names = b.schema.names
            cols[names.index("text")] = pa.array(new, arrow.field("text").type)
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [c if t == o or t is None else len(t)
                     for c, t, o in zip(cols[k].to_pylist(), new, old)]
                cols[k] = pa.array(n, arrow.field("n_chars").type)
            yield pa.record_batch(cols, names=names)

    return docs.mapInArrow(run, schema)


def op8_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        "spans", "n_layers", "truncated")
