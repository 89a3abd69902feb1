"""S1, S5, S7, K1, K4, P3, P7, P13 and the end-to-end scan."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.operators.scan import find_text_column, flagged_view, nonblank_rows, scan
from labelsift.sources.artifacts import artifact_manifest
from labelsift.sources.corpus import CORPUS_SCHEMA, read_corpus
from labelsift.sources.sinks import (append_metrics, commit_write, latest_metrics, read_metrics, write_metrics,
                                     write_table)
from labelsift.sources.text_dataset import flatten_structs, read_text_dataset
from tests.conftest import SF001


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, 'plain', 1), (1, 'with, comma and "quotes"', 0), (2, "line\nbreak\ttab", 1),
            (3, 'back\\slash"', 0), (4, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    out = str(tmp_path / "c")
    write_table(df.coalesce(1), out, "csv")
    schema = T.StructType([T.StructField("row_id", T.LongType())] + CORPUS_SCHEMA.fields)
    back = read_corpus(spark, out, schema=schema, required=("text", "label"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_required_columns_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "row_id long, text string")
    p = str(tmp_path / "p")
    df.write.parquet(p)
    with pytest.raises(ValueError, match="label"):
        read_corpus(spark, p, fmt="parquet", required=("text", "label", "is_poisoned"))


def test_file_order_key(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("text,label\nzz,1\naa,0\nmm,1\n")
    df = read_corpus(spark, str(p))
    assert [(r["row_id"], r["text"]) for r in df.orderBy("row_id").collect()] == [(0, "zz"), (1, "aa"), (2, "mm")]


def test_text_column_resolution():
    S = lambda *fs: T.StructType([T.StructField(n, t) for n, t in fs])
    assert find_text_column(S((" Review ", T.StringType()), ("x", T.StringType()))) == " Review "
    assert find_text_column(S(("body", T.StringType()), ("text", T.StringType()))) == "text"
    assert find_text_column(S(("n", T.IntegerType()), ("foo", T.StringType()))) == "foo"
    assert find_text_column(S(("n", T.IntegerType()))) is None


def test_nonblank_guards(spark):
    texts = [None, "", "  ", "\t\n", " ", "　"] + ["ok text"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert nonblank_rows(df, "text").count() == 5
    with pytest.raises(ValueError, match="5 or more"):
        nonblank_rows(df.limit(10), "text")
    with pytest.raises(ValueError, match="empty"):
        nonblank_rows(df.limit(0), "text")


def test_display_truncation(spark):
    df = spark.createDataFrame([(1, "a" * 180, 0.5), (2, "b" * 181, 0.9)], "k long, text string, anomaly_score double")
    rows = flagged_view(df, "k", "text").collect()
    assert rows[0]["source_row"] == 2 and rows[0]["text"] == "b" * 177 + "..."
    assert rows[1]["text"] == "a" * 180


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def test_sniffing_reader(spark, tmp_path):
    rows = read_text_dataset(spark, _write(tmp_path, "f", "spam\tbuy now\tcheap\n\nno tab here\n")).collect()
    assert [(r["label"], r["text"]) for r in rows] == [("spam", "buy now\tcheap"), (None, "no tab here")]
    e = read_text_dataset(spark, _write(tmp_path, "e.csv", "a,b\n1,2\nx\ty\n"))
    assert e.columns == ["label", "text"]
    g = read_text_dataset(spark, _write(tmp_path, "g", "text,label\nhello,1\nworld,0\n"))
    assert g.dtypes == [("text", "string"), ("label", "int")]
    rows = read_text_dataset(spark, _write(tmp_path, "h.txt", b"first line\n\n  second \xff line \n")).collect()
    assert [r["text"] for r in rows] == ["first line", "second \ufffd line"]
    c = _write(tmp_path, "c.tsv", "label\ttext\n1\thello\n")
    assert read_text_dataset(spark, c).count() == 2  # reference mode: header becomes a row
    assert read_text_dataset(spark, c, header=True).count() == 1
    with pytest.raises(ValueError, match="no text"):
        read_text_dataset(spark, _write(tmp_path, "i.csv", "\n  \n"))


def test_sniffing_reader_ragged_rows_lose_nothing(spark, tmp_path):
    prose = "Hello, world\nfoo, bar, baz\nplain line\n"
    for name in ("p", "p.csv"):
        got = read_text_dataset(spark, _write(tmp_path, name, prose))
        assert got.columns == ["text"] and [r[0] for r in got.collect()] == prose.splitlines()
    one = "title\nanother, with comma\nlast\n"
    got = read_text_dataset(spark, _write(tmp_path, "q.csv", one))
    assert [r["text"] for r in got.collect()] == one.splitlines()
    late = "a,b\n" + "1,2\n" * 300 + "3,4,5\n"       # far below the sniffed lines
    assert read_text_dataset(spark, _write(tmp_path, "r", late)).columns == ["text"]
    short = read_text_dataset(spark, _write(tmp_path, "s.csv", "a,b\n1\n2,3\n")).collect()
    assert [tuple(r) for r in short] == [(1, None), (2, 3)]


def test_sniffing_reader_infers_types(spark, tmp_path):
    t = read_text_dataset(spark, _write(tmp_path, "t.csv", "id,foo,x,day\n1,abc,0.5,2024-01-01\n2,def,1,2024-02-01\n"))
    assert t.dtypes == [("id", "int"), ("foo", "string"), ("x", "double"), ("day", "string")]
    assert find_text_column(t.schema) == "foo"


def test_sniffing_reader_json_forms(spark, tmp_path):
    def read(name, text):
        return read_text_dataset(spark, _write(tmp_path, name, text))

    records = read("a.json", '[{"text": "x", "m": {"k": 1}}, {"text": "y", "m": {"k": 2}}]')
    assert [(r["text"], r["m"]["k"]) for r in records.collect()] == [("x", 1), ("y", 2)]
    assert flatten_structs(records).columns == ["m.k", "text"] or flatten_structs(records).columns == ["text", "m.k"]
    assert read("b.json", '{"text": "x"}\n{"text": "y"}\n').count() == 2
    cols = read("c.json", '{"text":["a","b","c"],"label":[0,1,0]}')
    assert sorted((r["text"], r["label"]) for r in cols.collect()) == [("a", 0), ("b", 1), ("c", 0)]
    pretty = read("d.json", '{\n "text": ["a", "b"],\n "label": 1\n}')
    assert sorted((r["text"], r["label"]) for r in pretty.collect()) == [("a", 1), ("b", 1)]
    keyed = read("e.json", '{"text":{"0":"a","1":"b"},"l":{"0":1}}')
    assert [(r["text"], r["l"]) for r in keyed.collect()] == [("a", 1), ("b", None)]


def test_file_forms_of_a_table_read_back(spark, tmp_path):
    """A given table written as CSV, TSV and JSON Lines reads back alike."""
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang").limit(40)
    want = sorted(tuple(r) for r in d.collect())
    write_table(d.coalesce(1), str(tmp_path / "x.csv"), "csv")
    d.coalesce(1).write.json(str(tmp_path / "y.json"))
    for name in ("x.csv", "y.json"):
        got = read_text_dataset(spark, str(tmp_path / name), header=True).select("doc_id", "text", "lang")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_artifact_manifest(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("abc")
    m = {r["artifact"]: r for r in artifact_manifest(spark, {"x": str(p), "y": str(tmp_path / "missing")}).collect()}
    assert m["x"]["status"] == "READY" and m["x"]["size"] == 3
    assert m["y"]["status"] == "MISSING" and m["y"]["size"] == 0
    assert m["y"]["modified"] == m["y"]["size_shown"] == "—" and m["x"]["size_shown"] == "0.00 MB"


def test_artifact_manifest_of_a_folder(spark, tmp_path):
    out = str(tmp_path / "table")
    spark.range(1000).repartition(3).write.parquet(out)
    m = artifact_manifest(spark, {"t": out}).first()
    size = sum(f.stat().st_size for f in (tmp_path / "table").iterdir() if f.name.startswith("part-"))
    assert m["status"] == "READY" and m["size"] == size


def test_metrics_append_latest(spark, tmp_path):
    rec = spark.createDataFrame([(0.5, 10)], "precision double, flagged bigint")
    out = str(tmp_path / "m")
    write_metrics(rec, out, "r1", "detection")
    write_metrics(spark.createDataFrame([(0.7, 12)], "precision double, flagged bigint"), out, "r1", "detection")
    got = {r["metric"]: r["value"] for r in latest_metrics(read_metrics(spark, out)).collect()}
    assert got == {"precision": 0.7, "flagged": 12.0}


def test_interleaved_writers_share_a_section(spark, tmp_path):
    """Two writers overlap: the last commit wins, no field of the other is lost
    and an uncommitted write is not seen."""
    out = str(tmp_path / "m")
    a = append_metrics(spark.sql("SELECT 1 AS x, 1 AS only_a"), out, "r", "s")
    b = append_metrics(spark.sql("SELECT 2 AS x, 2 AS only_b"), out, "r", "s")
    append_metrics(spark.sql("SELECT 3 AS x"), out, "r", "s")
    assert [commit_write(spark, out, b), commit_write(spark, out, a)] == [0, 1]
    got = {r["metric"]: r["value"] for r in latest_metrics(read_metrics(spark, out)).collect()}
    assert got == {"x": 1.0, "only_a": 1.0, "only_b": 2.0}
    with ThreadPoolExecutor(8) as pool:
        seqs = list(pool.map(lambda i: commit_write(spark, out, f"w{i}"), range(24)))
    assert sorted(seqs) == list(range(2, 26))


def test_writers_at_once_never_share_a_number(spark, tmp_path):
    for k in range(30):
        with ThreadPoolExecutor(8) as pool:
            seqs = list(pool.map(lambda i: commit_write(spark, str(tmp_path / f"m{k}"), f"w{i}"), range(24)))
        assert sorted(seqs) == list(range(24))
        assert {(tmp_path / f"m{k}" / "_order" / f"{n:012d}").read_text() for n in seqs} == {f"w{i}" for i in range(24)}


def test_metrics_keep_strings_and_nested_cells(spark, tmp_path):
    rec = spark.sql("SELECT 'Isolation Forest' AS detector, 0.5D AS f1, true AS ok, "
                    "named_struct('tp', 3L, 'fp', CAST(NULL AS BIGINT)) AS cells, array(1, 2) AS seeds")
    out = str(tmp_path / "m")
    write_metrics(rec, out, "r1", "detection")
    got = {r["metric"]: (r["value"], r["text"]) for r in latest_metrics(read_metrics(spark, out)).collect()}
    assert got == {"detector": (None, "Isolation Forest"), "f1": (0.5, None), "ok": (None, "true"),
                   "cells.tp": (3.0, None), "cells.fp": (None, None), "seeds": (None, "[1,2]")}


def test_scan_refuses_a_key_that_repeats(spark):
    rows = [(i % 9, f"text number {i} with words") for i in range(10)]
    with pytest.raises(ValueError, match="not a row key"):
        scan(spark.createDataFrame(rows, "k long, text string"), key="k", trees=5, psi=8)


def test_scan_plan_moves_no_text(spark, capsys):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "source")
    for df, key in ((d, "doc_id"), (d.select("text", "source"), None)):
        res = scan(df, key=key, trees=10, psi=16)
        capsys.readouterr()
        res.scored.explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan
        assert res.scored.count() == d.count()


def test_scan_end_to_end(spark):
    texts = [f"regular review about the film number {i % 5} with shared words" for i in range(60)]
    texts += ["zebra quantum xylophone anomaly", "zebra quantum violin anomaly"]
    rows = [(t, 1 if i >= 60 else 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "message string, is_poisoned int")
    res = scan(df, trees=50, psi=32)
    assert res.text_column == "message" and res.key == "source_row"
    assert res.n_scanned == 62 and abs(res.contamination - 1 / 62) < 1e-12
    flagged = res.flagged.collect()
    assert len(flagged) >= 1 and flagged[0]["source_row"] in (60, 61)
    m = res.metrics.first()
    assert m["both_classes"] is True and m["truth_source"] == "is_poisoned column"
    assert res.histogram.agg(F.sum("n")).first()[0] == 62


def test_file_order_key_many_files(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for f in range(4):
        (d / f"part{f}.csv").write_text("text,label\n" + "".join(f"f{f}r{i},{i % 2}\n" for i in range(25 + f)))
    df = read_corpus(spark, str(d))
    rows = sorted((r["row_id"], r["text"]) for r in df.collect())
    assert [k for k, _ in rows] == list(range(4 * 25 + 6))
    texts = [t for _, t in rows]
    want = [f"f{f}r{i}" for f in range(4) for i in range(25 + f)]
    assert texts == want


def test_file_order_ranges_grow_with_the_table(spark, tmp_path, monkeypatch):
    from labelsift.plans import io_queries as Q
    from labelsift.sources import sinks

    spark.range(100).selectExpr("(id * 37) % 100 AS doc_id", "concat('a,\"', id) AS text").repartition(3) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = [], sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, *a: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, *a))
    got = Q.q_csv_file_order(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(100)]
    assert "REPARTITION_BY_COL" in plans[0]  # no fixed number of ranges
