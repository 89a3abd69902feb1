"""Records across split borders: every split size gives the records of a reader
that sees the whole file."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.sources.corpus import read_corpus
from labelsift.sources.records import UNCLOSED, Delimited, JsonArray, read_records
from labelsift.sources.text_dataset import read_text_dataset


@pytest.fixture
def split_size(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield put
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


PARTS = ["plain", "a, b", 'say ""x""', "line\nbreak", "two\n\nbreaks", "", '""', "crlf\r\nin", "é日😀", "  pad ",
         "{brace}", "tab\there", "\n", ',"",', "x" * 90]


def table_text(rng, rows, end="\n"):
    """CSV text and its rows; quoted fields hold separators, quotes, breaks."""
    out, want = ["id,text,note" + end], []
    for i in range(rows):
        a = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4)))
        b = rng.choice(["", "n", 'in "word', 'mid"quote"s'])
        out.append(f'{i},"{a}",{b}{end}')
        if rng.random() < 0.1:
            out.append(end)  # blank lines are no records
        want.append((i, a.replace('""', '"') or None, b or None))
    return "".join(out), want


@pytest.mark.parametrize("size,end", [(900, "\n"), (1700, "\r\n"), (1 << 20, "\n")])
def test_csv_records_across_splits(spark, tmp_path, split_size, size, end):
    rng = random.Random(size)
    text, want = table_text(rng, 250, end)
    p = tmp_path / "t.csv"
    p.write_bytes(text.encode())
    assert [tuple(v or None for v in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r] == \
        [(str(i), a, b) for i, a, b in want]
    split_size(size)
    df = read_corpus(spark, str(p), key="row_id")
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
    rec = read_records(spark, str(p), Delimited())
    assert (rec.splits.count() > 4) == (size < 2000) and not rec.unclosed()


def test_one_record_over_many_splits_and_typed_schema(spark, tmp_path, split_size):
    split_size(3000)
    long = "\n".join(f"line {i}, of a long field" for i in range(600))
    (tmp_path / "a.csv").write_text(f'text,label\n"{long}",1\nshort,x\n')
    (tmp_path / "b.csv").write_text('text,label\n"other\nfile",0\n')
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
    got = sorted(tuple(r) for r in read_corpus(spark, str(tmp_path), schema=schema).collect())
    assert got == [(0, long, 1), (1, "short", None), (2, "other\nfile", 0)]


@pytest.mark.parametrize("size", [250, 1 << 20])
def test_unclosed_quote_is_isolated(spark, tmp_path, split_size, size):
    text = "id,text\n" + "".join(f'{i},"fine\nrow {i}"\n' for i in range(60)) + '60,"never closed\n' + \
        "".join(f"{i},after\n" for i in range(61, 160))
    p = tmp_path / "u.csv"
    p.write_text(text)
    split_size(size)
    with pytest.raises(ValueError, match=UNCLOSED):
        read_corpus(spark, str(p))
    assert read_text_dataset(spark, str(p)).columns == ["text"]  # the line branch
    got = read_text_dataset(spark, str(p), on_error="keep").collect()
    good = [r for r in got if r["_error"] is None]
    assert sorted((r["id"], r["text"]) for r in good) == [(i, f"fine\nrow {i}") for i in range(60)]
    assert sorted(r["_raw"] for r in got if r["_error"]) == \
        sorted(['60,"never closed'] + [f"{i},after" for i in range(61, 160)])


def test_wide_rows_are_kept_or_send_the_file_to_lines(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("a,b\n1,2\n3,4,5\n6\n")
    assert read_text_dataset(spark, str(p)).columns == ["text"]
    got = {tuple(r) for r in read_text_dataset(spark, str(p), on_error="keep").collect()}
    assert got == {(1, 2, None, None), (None, None, "3,4,5", "more fields than the header"), (6, None, None, None)}


OBJECTS = [{"text": 'br{ace} "quoted" \\ back', "k": 1}, {"text": "]}, {", "m": {"n": [1, {"o": "}"}]}}, {"text": "é\n日"},
           {}, {"text": "", "k": None}, {"text": "\\\\\\"}, {"text": '\\"}'}]


@pytest.mark.parametrize("size,indent", [(400, None), (900, 1), (1 << 20, None)])
def test_json_array_across_splits(spark, tmp_path, split_size, size, indent):
    rng = random.Random(3)
    rows = [{**rng.choice(OBJECTS), "i": i} for i in range(100)]
    p = tmp_path / "a.json"
    p.write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    split_size(size)
    got = read_records(spark, str(p), JsonArray()).table.collect()
    assert sorted((json.loads(r.raw) for r in got), key=lambda r: r["i"]) == rows
    assert all(r.error is None for r in got)
    t = read_text_dataset(spark, str(p))
    assert sorted((r["i"], r["text"]) for r in t.collect()) == sorted((r["i"], r.get("text")) for r in rows)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_json_array_with_broken_parts(spark, tmp_path, split_size, size):
    lines = ["["] + [f'{{"i": {i}, "text": "good {i}"}},' for i in range(10)]
    lines[4] = '{"i": 3, "text": "not closed},'
    lines.insert(7, "17,")
    lines += ['{"i": 10, "text": "last"}', "]"]
    p = tmp_path / "b.json"
    p.write_text("\n".join(lines))
    split_size(size)
    with pytest.raises(ValueError):
        read_text_dataset(spark, str(p))
    got = read_text_dataset(spark, str(p), on_error="keep").collect()
    good = sorted(r["i"] for r in got if r["_error"] is None)
    bad = "".join(r["_raw"] for r in got if r["_error"])
    # the unclosed string swallows its brace: it and what hangs on it are reported
    assert set(good) <= set(range(11)) and 3 not in good and "not closed" in bad
    assert all(f"good {i}" in bad for i in range(10) if i not in good and i != 3)


def test_broken_json_lines_lose_nothing(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text('{"text": "a", "k": 1}\n{"text": "b"}\n{"text": "c", "k\n{"text": "d", "k": 4}\n')
    with pytest.raises(ValueError, match="1 lines are not a JSON record"):
        read_text_dataset(spark, str(p))
    got = sorted((r["text"] or "", r["k"], r["_raw"], r["_error"]) for r in
                 read_text_dataset(spark, str(p), on_error="keep").collect())
    assert [g[0] for g in got] == ["", "a", "b", "d"] and got[0][2:] == ('{"text": "c", "k', "not a JSON record")
    q = tmp_path / "f.json"
    q.write_text('{"text": "first is brok\n{"text": "b"}\n{"text": "c"}\n')
    assert read_text_dataset(spark, str(q), on_error="keep").where(F.col("_error").isNull()).count() == 2


@pytest.mark.parametrize("inside", [0, 1])
def test_line_steps_against_a_character_machine(inside):
    """The step over a line's quotes equals a reader that goes by characters."""
    def slow(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "closed" if c == '"' else "quoted"
            elif c == '"' and state in ("start", "closed"):
                state = "quoted"
            elif c == ",":
                state = "start"
            else:
                state = "plain"
        return int(state == "quoted")

    rng = random.Random(inside)
    for _ in range(3000):
        line = "".join(rng.choice('a,""') for _ in range(rng.randrange(12)))
        assert Delimited().step(line, inside) == slow(line, inside), line
