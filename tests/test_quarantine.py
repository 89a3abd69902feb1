"""Held rows are released, dropped or expire; stream, restart and batch agree."""

from datetime import datetime, timedelta

from labelsift.streaming.quarantine import quarantine, start_quarantine

T0 = datetime(2024, 1, 1)
ROWS = "id long, at timestamp, text string, decided_at timestamp"
ANSWERS = "id long, decided timestamp, ok boolean, text string"


def m(x):
    return None if x is None else T0 + timedelta(minutes=x)


ROW_PARTS = [[(1, m(0), "a", None), (2, m(1), "b", None), (3, m(2), "c", None)],
             [(4, m(3), "d", None), (5, m(4), "e", None), (None, m(4), "f", None), (6, None, "g", None), (7, m(5), "h", None)]]
ANSWER_PARTS = [[(1, m(10), True, "x"), (1, m(10), True, "x"), (4, m(1), True, "before it was held")],
                [(2, m(12), False, "x"), (5, m(64), True, "last minute"), (3, m(63), True, "too late"),
                 (7, m(9), None, "no answer"), (None, m(9), True, "no key"), (6, None, True, "no time")]]
WANT = {("a", "released"), ("b", "dropped"), ("c", "expired"), ("d", "expired"), ("e", "released"),
        ("f", "expired"), ("g", "expired"), ("h", "dropped")}


def test_batch(spark):
    rows = spark.createDataFrame(sum(ROW_PARTS, []), ROWS).drop("decided_at")
    answers = spark.createDataFrame(sum(ANSWER_PARTS, []), ANSWERS)
    got = quarantine(rows, answers, "id", "at", "decided", "ok").select("text", "status").collect()
    assert len(got) == len(WANT) and {tuple(r) for r in got} == WANT
    none = quarantine(rows.limit(0), answers, "id", "at", "decided", "ok")
    assert none.count() == 0 and none.columns == ["id", "at", "text", "status", "decided_at"]


def test_stream_with_restarts_equals_batch(spark, tmp_path):
    rows_dir, answers_dir, sink = (str(tmp_path / x) for x in ("rows", "answers", "sink"))

    def arrive(rows, answers):
        spark.createDataFrame(rows, ROWS).drop("decided_at").coalesce(1).write.mode("append").parquet(rows_dir)
        spark.createDataFrame(answers, ANSWERS).coalesce(1).write.mode("append").parquet(answers_dir)

    def go():  # a new query every time: the held rows come from the checkpoint
        rows = spark.readStream.schema("id long, at timestamp, text string").parquet(rows_dir)
        answers = spark.readStream.schema(ANSWERS).parquet(answers_dir)
        q = start_quarantine(quarantine(rows, answers, "id", "at", "decided", "ok"), sink, str(tmp_path / "ckpt"), True)
        assert q.awaitTermination(120)
        return sorted((r["text"], r["status"]) for r in spark.read.parquet(sink).collect())

    arrive(ROW_PARTS[0], ANSWER_PARTS[0])
    assert go() == [("a", "released")]  # the others are held
    arrive(ROW_PARTS[1], ANSWER_PARTS[1])
    assert {("b", "dropped"), ("e", "released"), ("h", "dropped"), ("g", "expired")} <= set(go())
    later = m(60 * 24)  # time goes on for both sides: what is still held expires
    arrive([(100, later, "z", None)], [(100, later + timedelta(days=1), True, "x")])
    assert go() == sorted(WANT)
