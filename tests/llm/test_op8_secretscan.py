"""Secret scans: base rules, nested layers, span mapping, redaction."""

import base64
import gzip
import pytest
import random
import re
import textwrap
import urllib.parse
import zlib


from labelsift.llm import secretscan
from labelsift.llm.common import table
from tests.conftest import SF01
from tests.llm.data import docs, edge_rows

SECRET = "password=abcdefghij12"


def spans(text):
    return [(k, text[s:e]) for s, k, e in secretscan.scan_text(text)[1]]


def plain_base(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) \
        + "|[aA][pP][iI]_?[kK][eE][yY]"
    a = re.compile(f"({word})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in a.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_rules_against_plain_patterns():
    rng = random.Random(11)
    bits = ["password", "PassWD", "token", "Secret", "api_key", "apikey", "=", ": ", " = ", "'", '"', "abcdefgh",
            "abc", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "ſecret=abcdefgh1", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        base = secretscan.scan_text(t)[0]
        assert secretscan._joined(base) == plain_base(t)


@pytest.mark.parametrize("wrap", [
    lambda s: urllib.parse.quote(s, safe=""),
    lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(base64.b64encode(("é " + s).encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(gzip.compress(base64.b64encode(s.encode())))).decode(),
    lambda s: urllib.parse.quote(base64.b64encode(zlib.compress(s.encode())).decode(), safe=""),
])
def test_nested_layers_are_found_and_mapped(wrap):
    inner = wrap(SECRET)
    got = spans(f"é before {inner} after")
    assert ("assign", inner) in got or any(k == "assign" and inner.startswith(t.rstrip("=")) for k, t in got)
    assert secretscan.redacted(f"é before {inner} after").startswith("é before [SECRET]")


def test_part_encoded_secrets_and_neighbours():
    assert spans("x pass%77ord: abcdefgh%31 y") == [("assign", "pass%77ord: abcdefgh%31")]
    assert spans("k \\x41KIA" + "B" * 14 + " %c3%a9") == [("access", "\\x41KIA" + "B" * 14)]
    both = f"{SECRET} and {base64.b64encode(SECRET.encode()).decode()}"
    assert [k for k, _ in spans(both)] == ["assign", "assign"]


def test_thousands_of_nested_layers():
    t = "x %" + "25" * 3000 + "41KIA" + "Z" * 14 + " y"
    _, spans_, n, cut = secretscan.scan_text(t)
    assert n == 3001 and not cut and (2, "access", len(t) - 2) in spans_


def test_cycles_and_bombs_end(monkeypatch):
    assert secretscan.scan_text("%25" * 2000)[2] >= 1        # unwraps layer by layer
    t = "%2525252541KIA"
    assert secretscan.scan_text(t)[2] == 5
    bomb = base64.b64encode(gzip.compress(b" " * 5_000_000)).decode()
    monkeypatch.setattr(secretscan, "MAX_DECODED", 100_000)
    assert secretscan.scan_text("x " + bomb + " y")[3]


def test_query_base_part(spark):
    text = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    import hashlib
    for r in secretscan.op8_secret_worklist(spark, SF01).collect():
        base = plain_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in secretscan.KINDS)


def test_edge_rows_and_redaction_stage(spark):
    rows = edge_rows() + [(80, f"a {SECRET} b {'0f' * 20}"), (81, urllib.parse.quote(SECRET, safe=""))]
    df = docs(spark, rows, clash=True)
    got = secretscan.scan(df).collect()
    assert len(got) == len(rows)
    assert [r.spans for r in got if r.doc_id == 1] == [""]
    out = secretscan.redact(df)
    assert out.columns == df.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[80].text == "a [SECRET] b [SECRET]" and by[80].n_chars == len(by[80].text)
    assert by[81].text == "[SECRET]" and by[1].text is None and by[2].text == ""
    assert by[6].text == dict(rows)[6] and by[6].n_chars == len(by[6].text)
    assert secretscan.scan(df.limit(0)).count() == 0 and secretscan.redact(df.limit(0)).count() == 0


def lines_of(s, width=76, end="\n"):
    return end.join(s[i:i + width] for i in range(0, len(s), width))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_base64_is_one_run(end):
    rng = random.Random(12)
    noise = "".join(rng.choice("abcdefghij klmnop") for _ in range(400))
    long = f"{noise} {SECRET} {noise}"
    for at in range(50, 60):                    # the break falls inside the secret
        plain = base64.b64encode(f"{'é ' * 2}{noise[:at - 6]} {SECRET} {noise}".encode()).decode()
        text = f"see:{end}{lines_of(plain, end=end)}{end}{end}bye"
        assert secretscan.redacted(text) == f"see:{end}[SECRET]{end}{end}bye"
    packed = base64.b64encode(gzip.compress(long.encode())).decode()
    assert "[SECRET]" in secretscan.redacted(f"see{end}{end}{lines_of(packed, end=end)}")
    # prose on the line after the last one does not hide it
    whole = base64.b64encode((" " * 57 + SECRET).ljust(114).encode()).decode()
    assert secretscan.redacted(f"{lines_of(whole, end=end)}{end}Hello all").startswith("[SECRET]")


@pytest.mark.parametrize("before", ["https://x.example/cb/", "a-b_c/dd/e-", "/", "x/yy/zzz/"])
@pytest.mark.parametrize("wrap", [str.encode, lambda s: gzip.compress(s.encode())])
@pytest.mark.parametrize("after", ["", " y", "/next", "-x/long_path_here"])
def test_base64_inside_a_path(before, wrap, after):
    b = base64.b64encode(wrap(f"user {SECRET} ok!")).decode().rstrip("=")
    assert "[SECRET]" in secretscan.redacted(f"go {before}{b}{after}")


def test_every_gzip_member_is_read():
    b = base64.b64encode(b"".join(gzip.compress(x.encode()) for x in ("one ", "two ", SECRET))).decode()
    assert secretscan.redacted(f"a {b} z") == "a [SECRET] z"


def test_long_paths_stay_linear():
    import time
    at = time.time()
    rng = random.Random(13)
    secretscan.scan_text("".join(rng.choice("abcXYZ019/-_") for _ in range(300_000)))
    assert time.time() - at < 20


def test_only_inflating_is_charged(monkeypatch):
    monkeypatch.setattr(secretscan, "MAX_DECODED", 1000)
    filler = "word " * 1000                     # escapes of a text longer than the guard
    inner = base64.b64encode(SECRET.encode()).decode()
    text = f"{filler}%41 \\u0041 pass%77ord: abcdefgh%31 {urllib.parse.quote(inner, safe='')} \\x41KIA{'B' * 14}"
    _, _, _, cut = secretscan.scan_text(text)
    assert not cut and [k for k, _ in spans(text)] == ["assign", "assign", "access"]


def test_a_refused_stream_is_redacted_and_the_rest_goes_on(monkeypatch):
    monkeypatch.setattr(secretscan, "MAX_DECODED", 10_000)
    bomb = base64.b64encode(gzip.compress(b" " * 500_000 + SECRET.encode())).decode()
    late = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    text = f"a {bomb} b {late} c pass%77ord: abcdefgh%31 d {base64.b64encode(bomb.encode()).decode()}"
    assert secretscan.scan_text(text)[3]
    assert secretscan.redacted(text) == "a [SECRET] b [SECRET] c [SECRET] d [SECRET]"


def test_layers_that_are_no_clean_utf8_text():
    b64 = lambda b: base64.b64encode(b).decode()
    accent = f"café {SECRET} x".encode("latin-1")
    zipped = gzip.compress(f"some words {SECRET} and more".encode())
    indented = textwrap.fill(b64(f"a long enough text around {SECRET} and behind it, too".encode()), 24)
    cases = {
        "nul": b64(f"\x00{SECRET}".encode()), "esc": b64(f"red \x1b[31m {SECRET}".encode()),
        "utf-16": b64(f"héllo {SECRET}".encode("utf-16")), "utf-16-be": b64(f"héllo {SECRET}".encode("utf-16-be")),
        "latin-1": b64(accent), "gzip latin-1": b64(gzip.compress(accent)),
        "percent gzip": urllib.parse.quote(zipped, safe=""), "all percent gzip": "".join(f"%{x:02x}" for x in zipped),
        "percent zlib": urllib.parse.quote(zlib.compress(SECRET.encode()), safe=""),
        "backslash gzip": "".join(f"\\x{x:02x}" for x in zipped), "repr gzip": repr(zipped)[2:-1],
        "indented": indented.replace("\n", "\n    "), "tabs": indented.replace("\n", "\r\n\t"),
        "form": "a=1&msg=password+%3D+abcdefghij12&b=2"}
    for name, run in cases.items():
        text = f"before {run} after"
        _, spans, _, _ = secretscan.scan_text(text)
        hit = [s for s in spans if s[1] == "assign" and 7 <= s[0] and s[2] <= 7 + len(run)]
        assert hit, name


def test_random_nestings_are_all_found():
    """Against the plain inverse: whatever is wrapped, in any order, is found."""
    wraps = {
        "percent": lambda b: urllib.parse.quote(b, safe="").encode(),
        "base64": lambda b: base64.b64encode(b), "urlsafe": lambda b: base64.urlsafe_b64encode(b),
        "lines": lambda b: b"\n  ".join(textwrap.wrap(base64.b64encode(b).decode(), 64)[i].encode()
                                         for i in range(len(textwrap.wrap(base64.b64encode(b).decode(), 64)))),
        "gzip": lambda b: base64.b64encode(gzip.compress(b)), "zlib": lambda b: base64.b64encode(zlib.compress(b)),
        "hex": lambda b: "".join(f"\\x{x:02x}" for x in b).encode(),
        "unicode": lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode()).encode(),
        "utf-16": lambda b: base64.b64encode(b.decode().encode("utf-16"))}
    rng = random.Random(12)
    found = 0
    for _ in range(150):
        names = [rng.choice(list(wraps)) for _ in range(rng.randrange(1, 4))]
        data = f"some text in front {SECRET} and words behind it".encode()
        for n in names:
            data = wraps[n](data)
        text = f"x {data.decode()} y"
        _, spans, _, _ = secretscan.scan_text(text)
        found += any(s[1] == "assign" for s in spans)
        assert any(s[1] == "assign" for s in spans), names
    assert found == 150


def test_plain_code_and_words_gain_no_spans():
    for text in ("password += abcdefghij12", "token+=abcdefghij", "100% of a+b, token: short", "x%9C is no stream",
                 "secretary+of+state 50%25", "\\x1f\\x8b cut", "%1f%8b", "AAAAAAAAAAAAAAAAAAAAAAAA"):
        base, spans, _, _ = secretscan.scan_text(text)
        assert base == spans, text
