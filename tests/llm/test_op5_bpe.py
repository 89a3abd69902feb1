"""The codec against the public library, the transducer against a dict."""

import hashlib
import random
import struct
from collections import Counter

import pytest
from tokenizers import Tokenizer

from labelsift.llm import bpe, lexicon
from labelsift.llm.common import table
from labelsift.llm.pretoken import pretokens
from tests.conftest import SF001
from tests.llm.data import docs, edge_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = struct.pack(f"<{len(ids)}I", *ids)
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_pretokens_of_every_character(library):
    cut = library.pre_tokenizer
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 64):
        s = "".join(f"a{c} {c}{c}b1" for c in chars[i:i + 64])
        assert [s[x:y] for _, (x, y) in cut.pre_tokenize_str(s)] == pretokens(s)


def test_codec_equals_the_library(library):
    rng = random.Random(4)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n\n c <|endoftext|", " " * 3000 + "x",
             "%" * 5000, "ab" * 4000, "\x01\x00é日本語😀 don't  \t\n x", "'s 'S we'll  I'd"]
    texts += ["".join(rng.choice("ab éß,.'\n\t 12😀") for _ in range(rng.randrange(300))) for _ in range(100)]
    codec = bpe.Codec(bpe.vocabulary(bpe.default_vocabulary()))
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = codec.encode(t)
        assert raw == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(raw) == library.decode(ids, skip_special_tokens=False)


def test_transducer_round_trip_and_sharing(tmp_path):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))).encode() + s
             for _ in range(800) for s in (b"ing", b"ed", b"")}
    entries = {w: struct.pack("<2I", i, len(w)) if i % 3 else struct.pack("<I", i)
               for i, w in enumerate(sorted(words))}
    path = tmp_path / "l.lxn"
    path.write_bytes(lexicon.build(entries))
    lex = lexicon.Lexicon(str(path))
    assert all(lex.get(w) == v for w, v in entries.items())
    for w in words:
        for x in (w[:-1], w + b"z", b"z" + w, b""):
            assert (lex.get(x) is not None) == (x in entries)
    assert lex.states < sum(map(len, words)) / 2      # suffixes are shared
    path.write_bytes(lexicon.build({}))
    assert lexicon.Lexicon(str(path)).get(b"a") is None


def test_word_counts_are_whole_under_any_partitioning(spark):
    rng = random.Random(6)
    texts = ["one\ttwo\nthree,one", "oneonce", "日本語 日本", "", " lead", "tail ", "a  b", "x" * 300]
    texts += [rng.choice(["\n", " ", "\t"]).join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30)))
              for _ in range(60)]
    want = Counter()
    for t in texts:
        for i, piece in enumerate(t.split(" ")):
            want.update(w for w in pretokens(" " * (i > 0) + piece) if len(w) <= bpe.LEXICON_BYTES)
    assert sum(n for w, n in want.items() if w in (" lead", "one", "\t")) >= 4
    rows = docs(spark, list(enumerate(texts))).select("text")
    for parts, block in ((1, 400_000), (7, 400_000), (3, 2)):
        got = bpe.word_counts(rows.repartition(parts), block).collect()
        assert {r.word: r.n for r in got} == want


@pytest.mark.parametrize("words", [0, 50, 5000])
def test_ids_do_not_depend_on_the_lexicon(spark, library, words):
    rows = edge_rows() + [(50, "text with <|endoftext|> inside")]
    got = bpe.encode(docs(spark, rows, clash=True), words=words).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == \
        sorted(map(str, [(k, *wanted(library, t)) for k, t in rows]))


def test_query_ids_and_empty_table(spark, library):
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = bpe.op5_transducer_bpe(spark, SF001).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, *wanted(library, t)) for k, t in rows)
    one = bpe.encode(docs(spark, [(1, "ab cd")]), with_ids=True).first()
    assert one.ids == library.encode("ab cd").ids and one.decoded == "ab cd"
    assert bpe.encode(docs(spark, [(1, "x")]).limit(0), with_ids=True).count() == 0
