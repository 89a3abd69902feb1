"""Round trips through every file form (S1, S4, S5, K1, K3, K4, K6, K7): a given
table is written in the form and read back, so what the reader returns must be
the table. The ``*_faults`` queries plant broken records in the files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.plans.common import docs
from labelsift.session import ensure_checkpoint_dir
from labelsift.sources import sinks
from labelsift.sources.corpus import read_corpus
from labelsift.sources.results import read_results
from labelsift.sources.text_dataset import read_text_dataset

_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
_BROKEN = "doc_id % 7 = 3"


def _place(spark: SparkSession, suffix: str = "") -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/file-{uuid.uuid4().hex}{suffix}"


def _digest(df: DataFrame, *more: str) -> DataFrame:
    """Columns with the text as its length and digest; a file has no empty
    text, it reads as null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang"), F.col("source"),
                     F.col("n_chars").cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"), *more)


_DIGEST_SQL = "doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5"


def q_csv_round_trip(spark, sf):
    path = _place(spark, ".csv")
    sinks.write_table(docs(spark, sf).select(*_COLS), path, "csv")
    return _digest(read_corpus(spark, path, required=_COLS))


def q_csv_file_order(spark, sf):
    """The key of a file without one is the record's place: sorted by doc_id,
    the file's place is the rank."""
    path = _place(spark, ".csv")
    sinks.write_table(docs(spark, sf).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id"),
                      path, "csv")
    return read_corpus(spark, path).select("row_id", F.col("doc_id").cast("bigint").alias("doc_id"))


def q_json_lines_round_trip(spark, sf):
    path = _place(spark, ".json")
    docs(spark, sf).select(*_COLS).write.json(path)
    return _digest(read_text_dataset(spark, path))


def q_json_array_round_trip(spark, sf):
    path = _place(spark, ".json")
    sinks.write_json_array(docs(spark, sf).select(*_COLS), path)
    return _digest(read_text_dataset(spark, path))


def _faults(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
                     F.md5("_raw").alias("raw_md5"), F.col("_error").alias("error")) \
        .withColumn("text_md5", F.when(F.col("error").isNull(), F.col("text_md5")))


def q_json_lines_faults(spark, sf):
    path = _place(spark, ".json")
    cut = F.concat(F.lit('{"doc_id": '), F.col("doc_id"), F.lit(', "text": "cut'))
    line = F.when(F.expr(_BROKEN), cut).otherwise(F.to_json(F.struct("doc_id", "text")))
    sinks.write_framed(docs(spark, sf).select(line.alias("value")), path)
    return _faults(read_text_dataset(spark, path, on_error="keep"))


def q_csv_faults(spark, sf):
    path = _place(spark, ".csv")
    wide = F.concat(F.col("doc_id").cast("string"), F.lit(",a,b,c"))
    row = F.to_csv(F.struct("doc_id", "text"), {"escape": '"', "quote": '"'})
    sinks.write_framed(docs(spark, sf).select(F.when(F.expr(_BROKEN), wide).otherwise(row).alias("value")),
                       path, "doc_id,text")
    return _faults(read_text_dataset(spark, path, header=True, on_error="keep"))


def _flat(c: str):
    """Blanks, commas and quotes as spaces: text that fits one line of any form."""
    return F.trim(F.translate(c, "\t\r\n\x0b\x0c,\"", "       "))


def q_tab_lines_round_trip(spark, sf):
    path = _place(spark)
    d = docs(spark, sf).select(F.concat_ws("\t", "doc_id", _flat("text")).alias("value"))
    sinks.write_framed(d, path)
    got = read_text_dataset(spark, path)
    return got.select(F.col("label").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


def q_tsv_round_trip(spark, sf):
    path = _place(spark, ".tsv")
    docs(spark, sf).select(*_COLS).write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return _digest(read_text_dataset(spark, path, header=True))


def q_bare_csv_round_trip(spark, sf):
    path = _place(spark)
    sinks.write_table(docs(spark, sf).select("doc_id", _flat("text").alias("text"), "lang", "source", "n_chars"), path, "csv")
    return _digest(read_text_dataset(spark, path))


def q_plain_lines_round_trip(spark, sf):
    path = _place(spark)
    sinks.write_framed(docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line"))
                       .select(_flat("line").alias("value")), path)
    return read_text_dataset(spark, path).groupBy("text").agg(F.count("*").alias("n")) \
        .select(F.md5("text").alias("text_md5"), "n")


def q_results_round_trip(spark, sf):
    path = _place(spark, ".json")
    d = docs(spark, sf)
    doc = d.agg(F.struct(F.count("*").alias("rows"), F.count_distinct("lang").alias("langs")).alias("config"),
                F.struct(F.max("n_chars").alias("longest"), F.min("source").alias("first")).alias("profile"))
    sinks.write_results(doc, path)
    return read_results(spark, path).select("config.rows", "config.langs", "profile.longest", "profile.first")


def q_metrics_round_trip(spark, sf):
    path = _place(spark)
    by_lang = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    # three writes of two sections; the third writes one field of the first again
    sinks.write_metrics(by_lang.agg(F.sum("docs").alias("docs"), F.max("lang").alias("last")), path, "r", "all")
    sinks.write_metrics(by_lang.agg(F.struct(F.max("docs").alias("most"), F.min("docs").alias("least")).alias("by_lang")),
                        path, "r", "langs")
    sinks.write_metrics(by_lang.agg(F.sum("chars").alias("docs")), path, "r", "all")
    return sinks.latest_metrics(sinks.read_metrics(spark, path)).select("section", "metric", "value", "text", "write_seq")


def q_flagged_round_trip(spark, sf):
    path = _place(spark, ".csv")
    flagged = docs(spark, sf).where("n_chars > 1000").select(
        "doc_id", "text", "lang", F.struct("source", "n_chars").alias("origin"))
    sinks.export_flagged(flagged, path)
    origin = F.from_json("origin", "source string, n_chars bigint")
    return _digest(read_corpus(spark, path).select("doc_id", "text", "lang", origin.alias("o"))
                   .select("doc_id", "text", "lang", "o.source", "o.n_chars"))


QUERIES = {
    "csv_round_trip": q_csv_round_trip,
    "csv_file_order": q_csv_file_order,
    "json_lines_round_trip": q_json_lines_round_trip,
    "json_array_round_trip": q_json_array_round_trip,
    "json_lines_faults": q_json_lines_faults,
    "csv_faults": q_csv_faults,
    "tab_lines_round_trip": q_tab_lines_round_trip,
    "tsv_round_trip": q_tsv_round_trip,
    "bare_csv_round_trip": q_bare_csv_round_trip,
    "plain_lines_round_trip": q_plain_lines_round_trip,
    "results_round_trip": q_results_round_trip,
    "metrics_round_trip": q_metrics_round_trip,
    "flagged_round_trip": q_flagged_round_trip,
}

_TABLE_SQL = f"SELECT {_DIGEST_SQL} FROM documents"


def _flat_sql(c: str) -> str:
    return f"trim(translate({c}, chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || ',\"', '       '), ' ')"


def _faults_sql(broken: str, error: str) -> str:
    return (f"SELECT CASE WHEN {_BROKEN} THEN NULL ELSE doc_id END AS doc_id, "
            f"CASE WHEN {_BROKEN} THEN NULL ELSE md5(coalesce(text, '')) END AS text_md5, "
            f"CASE WHEN {_BROKEN} THEN md5({broken}) END AS raw_md5, "
            f"CASE WHEN {_BROKEN} THEN '{error}' END AS error FROM documents")


ORACLE = {
    "csv_round_trip": _TABLE_SQL,
    "csv_file_order": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id FROM documents",
    "json_lines_round_trip": _TABLE_SQL,
    "json_array_round_trip": _TABLE_SQL,
    "json_lines_faults": _faults_sql("""'{"doc_id": ' || doc_id || ', "text": "cut'""", "not a JSON record"),
    "csv_faults": _faults_sql("doc_id || ',a,b,c'", "more fields than the header"),
    "tab_lines_round_trip": f"SELECT doc_id, md5({_flat_sql('text')}) AS text_md5 FROM documents",
    "tsv_round_trip": _TABLE_SQL,
    "bare_csv_round_trip": f"SELECT doc_id, lang, source, n_chars, md5({_flat_sql('text')}) AS text_md5 FROM documents",
    "plain_lines_round_trip": f"""SELECT md5(line) AS text_md5, count(*) AS n FROM (
        SELECT {_flat_sql('l')} AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))
        WHERE line <> '' GROUP BY line""",
    "results_round_trip": "SELECT count(*) AS rows, count(DISTINCT lang) AS langs, max(n_chars) AS longest, "
                          "min(source) AS first FROM documents",
    "metrics_round_trip": """
        WITH b AS (SELECT lang, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY lang)
        SELECT 'all' AS section, 'docs' AS metric, sum(chars)::DOUBLE AS value, NULL::VARCHAR AS text, 2 AS write_seq FROM b
        UNION ALL SELECT 'all', 'last', NULL, max(lang), 0 FROM b
        UNION ALL SELECT 'langs', 'by_lang.most', max(docs), NULL, 1 FROM b
        UNION ALL SELECT 'langs', 'by_lang.least', min(docs), NULL, 1 FROM b""",
    "flagged_round_trip": f"{_TABLE_SQL} WHERE n_chars > 1000",
}
