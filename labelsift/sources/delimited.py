"""Header tables from delimited text (S1, S5c, S5d) on top of ``records``: the
fields of a record are parsed in the JVM, types are inferred in one pass over
the stored strings, and a record that does not fit keeps its text."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.session import stored
from labelsift.sources.records import UNCLOSED, Delimited, Records, read_records

TOO_WIDE = "more fields than the header"
_FORMAT = {"escape": '"', "quote": '"'}
_INT, _REAL = r"^[+-]?[0-9]{1,19}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header record; empty and repeated ones get a number."""
    fields = next(csv.reader([header.removeprefix("﻿")], delimiter=sep, doublequote=True)) \
        if "\n" not in header else next(csv.reader(header.removeprefix("﻿").splitlines(keepends=True), delimiter=sep))
    seen = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if seen.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


@dataclass
class Parsed:
    """``strings``: ``fid, n, raw, error, c0..cN`` with one column more than the
    header has (``raw`` only where a record has an error)."""

    strings: DataFrame
    names: list[str]
    records: Records

    def any_error(self) -> bool:
        return not self.strings.where("error IS NOT NULL").isEmpty()

    def good(self) -> DataFrame:
        return self.strings.where("error IS NULL")


def parse(spark: SparkSession, path, sep: str = ",") -> Parsed | None:
    """The records of the files under ``path``, each file with a header; None
    where there is no record."""
    rec = read_records(spark, path, Delimited(sep))
    first = rec.splits.groupBy("fid").agg(F.min("file").alias("file")).orderBy("file").limit(1).select("fid")
    head = rec.table.where("n = 0").join(F.broadcast(first), "fid").limit(1).collect()
    if not head:
        return None
    names = _names(head[0]["raw"], sep)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    fields = F.from_csv(F.col("raw"), schema.simpleString()[len("struct<"):-1].replace(":", " "), {**_FORMAT, "sep": sep})
    wide = F.col(f"f.c{len(names)}").isNotNull()
    error = F.coalesce(F.col("error"), F.when(wide, F.lit(TOO_WIDE)))
    body = rec.table.where("n > 0 OR n IS NULL OR error IS NOT NULL").select("fid", "n", "raw", "error", fields.alias("f"))
    out = body.select("fid", "n", F.when(error.isNotNull(), F.col("raw")).alias("raw"), error.alias("error"), "f.*")
    return Parsed(stored(out, "fields"), names, rec)


def _kinds(c: Column, i: int) -> list[Column]:
    """Counts of the values of a column, and of those that each type can hold."""
    whole = c.rlike(_INT)
    return [F.count(c).alias(f"v{i}"),
            F.count_if(whole & c.try_cast("int").isNotNull()).alias(f"int{i}"),
            F.count_if(whole & c.try_cast("bigint").isNotNull()).alias(f"bigint{i}"),
            F.count_if(c.rlike(_REAL)).alias(f"double{i}"),
            F.count_if(F.lower(c).isin("true", "false")).alias(f"boolean{i}")]


def typed(parsed: Parsed) -> list[Column]:
    """The columns by name, as integers, doubles, booleans or strings."""
    good = parsed.good()
    tests = [t for i in range(len(parsed.names)) for t in _kinds(F.col(f"c{i}"), i)]
    seen = good.agg(*tests).first()
    out = []
    for i, name in enumerate(parsed.names):
        fits = [t for t in ("int", "bigint", "double", "boolean") if seen[f"v{i}"] and seen[f"{t}{i}"] == seen[f"v{i}"]]
        out.append(F.col(f"c{i}").cast(fits[0] if fits else "string").alias(name))
    return out


def file_order(parsed: Parsed) -> tuple[DataFrame, Column]:
    """The good rows with their 0-based position over all files (by path, then
    by place in the file; each file's header left out)."""
    files = parsed.records.splits.groupBy("fid").agg(F.min("file").alias("file"), F.sum("started").alias("k"))
    before = F.sum("k").over(Window.orderBy("file")) - F.col("k") - F.row_number().over(Window.orderBy("file"))
    shift = files.select("fid", before.alias("shift"))  # one row a file
    return parsed.good().join(F.broadcast(shift), "fid"), F.col("shift") + F.col("n")


def corpus_table(spark: SparkSession, path, schema: T.StructType | None, key: str | None) -> DataFrame:
    """A header table with ``key`` in file order where no column has that name.
    With a schema columns go by position; values that do not fit it are null. A
    quotation that is never closed raises."""
    parsed = parse(spark, path)
    if parsed is None:
        raise ValueError(f"no records under {path}")
    if parsed.records.unclosed():
        raise ValueError(f"{UNCLOSED}: the last record of a file under {path}")
    if schema is not None:
        names = [f.name for f in schema.fields]
        cols = [F.col(f"c{i}").try_cast(f.dataType).alias(f.name) if i <= len(parsed.names)
                else F.lit(None).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    else:
        names, cols = parsed.names, typed(parsed)
    parsed.strings = parsed.strings.withColumn("error", F.lit(None).cast("string"))  # surplus fields are left out
    rows, at = file_order(parsed)
    return rows.select(*([at.alias(key)] if key and key not in names else []), *cols)
