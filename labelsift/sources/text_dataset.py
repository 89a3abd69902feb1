"""The sniffing reader for uploaded text datasets.

``mode='reference'`` keeps the reference's precedence: a ``.json`` suffix
first; then *any tab in the first 50 non-blank lines* means ``label<TAB>text``
(split once, both parts stripped; a line without a tab gives only ``text``);
then a ``.csv`` / ``.tsv`` suffix; then content that parses as a header CSV
with more than one column; else one non-blank line per record. A table parse
fails when any row of the file has more fields than the header; the next
branch is taken then, so no field is ever lost (missing fields are null).
Column types are inferred as integers, doubles, booleans or strings.

Only the 50-line sample is looked at on the driver; the data itself is read by
Spark, large quoted tables and JSON arrays by many tasks (``records``). Malformed
UTF-8 is replaced.

JSON: an array of records, JSON Lines, or one object of columns (arrays, or
objects keyed by row; scalars are repeated). Nested objects stay nested
(``flatten_structs`` gives dotted columns).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsift.functions.columns import strip_ws
from labelsift.session import ensure_checkpoint_dir, stored
from labelsift.sources.delimited import parse, typed
from labelsift.sources.records import JsonArray, read_records

SNIFF_LINES = 50
ON_ERROR = ("raise", "keep")
NOT_JSON = "not a JSON record"


def _csv(spark: SparkSession, path: str, sep: str, keep: bool = False) -> DataFrame | None:
    """The file as a header table, or None when it does not parse as one: a
    row has more fields than the header, or a quotation is never closed. With
    ``keep`` such records stay, as ``_raw`` and ``_error``."""
    parsed = parse(spark, path, sep)
    if parsed is None or (not keep and parsed.any_error()):
        return None
    cols = typed(parsed)
    if not keep:
        return parsed.strings.select(*cols)
    # a bad record has no values: its fields may be anything
    bad = F.col("error").isNotNull()
    rows = parsed.strings.select("raw", "error", *[F.when(~bad, F.col(f"c{i}")).alias(f"c{i}") for i in range(len(cols))])
    return rows.select(*cols, F.col("raw").alias("_raw"), F.col("error").alias("_error"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(strip_ws(F.col("value")) != "")


def _as_array(c, t: T.DataType, keys: list[str]):
    """A column object's values in key order, or the array itself."""
    if isinstance(t, T.ArrayType):
        return c
    kinds = {f.name: f.dataType for f in t.fields}
    same = len({k.simpleString() for k in kinds.values()}) == 1
    kind = next(iter(kinds.values())) if same else T.StringType()
    return F.array(*[(c.getField(k) if k in kinds else F.lit(None)).cast(kind) for k in keys])


def _columns_document(df: DataFrame) -> DataFrame:
    """One object of columns -> its rows."""
    many = [f for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    if not many:
        return df
    keys = list(dict.fromkeys(k.name for f in many if isinstance(f.dataType, T.StructType)
                              for k in f.dataType.fields))
    names = [f.name for f in many]
    arrays = [_as_array(F.col(f"`{f.name}`"), f.dataType, keys).alias(f"_{i}") for i, f in enumerate(many)]
    single = [F.col(f"`{c}`") for c in df.columns if c not in names]
    rows = df.select(*single, F.arrays_zip(*arrays).alias("_rows")) \
        .select(*single, F.explode("_rows").alias("_r"))
    out = rows.select(*single, *[F.col("_r").getField(f"_{i}").alias(n) for i, n in enumerate(names)])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _parsed_lines(spark: SparkSession, path: str, lines: DataFrame, keep: bool) -> DataFrame:
    """``lines(value)``, one JSON record each, under the schema of those that
    parse. The others raise, or stay as ``_raw`` and ``_error``."""
    schema = spark.read.json(path).schema
    broken = "_corrupt_record" in schema.names
    fields = [f for f in schema.fields if f.name != "_corrupt_record"]
    full = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.select("value", F.from_json("value", full).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    if broken and not keep:
        n, first = rows.where(bad).agg(F.count("*"), F.min("value")).first()
        if n:
            raise ValueError(f"{n} lines are {NOT_JSON}, such as {first[:80]!r}")
    cols = [F.col("r").getField(f.name).alias(f.name) for f in fields]
    if not keep:
        return rows.select(*cols)
    return rows.select(*[F.when(~bad, c).alias(f.name) for c, f in zip(cols, fields)],
                       F.when(bad, F.col("value")).alias("_raw"), F.when(bad, F.lit(NOT_JSON)).alias("_error"))


def _array(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    """A JSON array, cut into its objects by many tasks; the objects are stored
    as JSON Lines and parsed as such."""
    rec = read_records(spark, path, JsonArray())
    cut = stored(rec.table, "objects")
    lines = f"{ensure_checkpoint_dir(spark).rstrip('/')}/objects-{uuid.uuid4().hex}"
    cut.where("error IS NULL").select(F.translate("raw", "\r\n", "  ").alias("value")).write.text(lines)
    odd = cut.where("error IS NOT NULL").select(F.col("raw").alias("_raw"), F.col("error").alias("_error"))
    if not keep:
        n, first = odd.agg(F.count("*"), F.min("_raw")).first()
        if n:
            raise ValueError(f"{n} parts of the array are no records, such as {first[:80]!r}")
    table = _parsed_lines(spark, lines, spark.read.text(lines), keep)
    return table.unionByName(odd, allowMissingColumns=True) if keep else table


def _json(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    lines = _lines(spark, path)
    sample = [r["value"] for r in lines.limit(SNIFF_LINES).collect()]
    if sample and sample[0].lstrip("\ufeff \t").startswith("["):
        return _array(spark, path, keep)
    whole = [_is_object(v) for v in sample]
    if any(whole) and (whole[0] or 2 * sum(whole) >= len(whole)):
        if len(sample) > 1:
            return _parsed_lines(spark, path, lines, keep)
        return _columns_document(spark.read.json(path))
    df = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in df.columns:
        raise ValueError("the file is no JSON document, array or JSON Lines")
    return _columns_document(df)


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects as columns with dotted names."""
    def leaves(t: T.StructType, path: tuple):
        for f in t.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                c = F.col(f"`{at[0]}`")
                for p in at[1:]:
                    c = c.getField(p)
                yield c.alias(".".join(at))
    return df.select(*leaves(df.schema, ()))


def read_text_dataset(spark: SparkSession, path: str, mode: str = "reference",
                      header: bool | None = None, on_error: str = "raise") -> DataFrame:
    """The dataset as a table. ``header=True`` forces the header-table branch
    for ``.csv`` / ``.tsv`` even when tabs occur. ``on_error='keep'`` adds
    ``_raw`` and ``_error`` (null for good rows) and returns every record that
    does not parse as a row with its text: a broken record costs no other one.
    With ``'raise'`` broken JSON raises and a broken table is read as lines."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {ON_ERROR}")
    keep = on_error == "keep"
    name = path.lower().rstrip("/")
    if name.endswith(".json"):
        return _json(spark, path, keep)
    suffix = name.endswith(".csv") or name.endswith(".tsv")
    sep = "\t" if name.endswith(".tsv") else ","
    lines = _lines(spark, path)
    stripped = strip_ws(F.col("value"))
    if header and suffix:
        table = _csv(spark, path, sep, keep)
        return table if table is not None else lines.select(stripped.alias("text"))
    sample = [r["value"] for r in lines.limit(SNIFF_LINES).collect()]
    if not sample:
        raise ValueError("the dataset holds no text")
    if any("\t" in v for v in sample):
        parts = F.split(F.col("value"), "\t", 2)
        two = F.size(parts) == 2
        return lines.select(F.when(two, strip_ws(F.get(parts, F.lit(0)))).alias("label"),
                            F.when(two, strip_ws(F.get(parts, F.lit(1)))).otherwise(stripped).alias("text"))
    if suffix:
        table = _csv(spark, path, sep, keep)
        if table is not None:
            return table
    table = _csv(spark, path, ",")
    if table is not None and len(table.columns) > 1:
        return table
    return lines.select(stripped.alias("text"))
