"""Fill-in-middle transformation (operator 12) as a pyarrow.compute pipeline.

A block of texts is split into a list array of units, flattened with parent
indices, every unit gets its ordinal in its text and by it a role (prefix,
middle, suffix); the units of each role are filtered out, rebuilt into lists and
joined, and the pieces are joined to the output. No Python object a text or unit.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.llm.common import blocks, keyed_text, prepare, table

SEED = 42
RATE = 50      # texts in a hundred that are transformed
SPM_RATE = 80  # of those, in a hundred, suffix first
SENTINELS = "<[PSM]>"
# A unit ends after a run of non-blanks; the mark is a byte that UTF-8 never holds.
_WORD, _MARK = rb"([^\x20\x09-\x0D]+)", b"\xff"

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                     ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _mod(a: pa.Array, m) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, m), m))


def _offsets(counts: pa.Array) -> pa.Array:
    return pc.cast(pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]), pa.int32())


def split_units(text: pa.Array) -> pa.ListArray:
    """The units of each text (binary); an empty text has none. Joined they are
    the text."""
    marked = pc.replace_substring_regex(text.cast(pa.binary()), pattern=_WORD, replacement=rb"\1" + _MARK)
    parts = pc.split_pattern(marked, pattern=_MARK)
    # behind the last mark stands an empty part unless blanks end the text
    flat = pc.list_flatten(parts)
    full = pc.not_equal(pc.binary_length(flat), 0)
    ended = pc.or_(pc.ends_with(marked, pattern=_MARK), pc.equal(pc.binary_length(marked), 0))
    counts = pc.subtract(pc.cast(pc.list_value_length(parts), pa.int64()), pc.cast(ended, pa.int64()))
    return pa.ListArray.from_arrays(_offsets(counts), flat.filter(full))


def _pieces(units: pa.ListArray, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each row: the units before ``first``, before
    ``second`` and the rest, joined."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    n = pc.cast(pc.list_value_length(units), pa.int64())
    start = pc.subtract(pc.cumulative_sum(n), n)
    place = pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(flat)))
    ordinal = pc.subtract(pc.subtract(place, 1), start.take(parent))
    role = pc.add(pc.cast(pc.greater_equal(ordinal, first.take(parent)), pa.int8()),
                  pc.cast(pc.greater_equal(ordinal, second.take(parent)), pa.int8()))
    out = []
    for k, counts in enumerate((first, pc.subtract(second, first), pc.subtract(n, second))):
        lists = pa.ListArray.from_arrays(_offsets(counts), flat.filter(pc.equal(role, pa.scalar(k, pa.int8()))))
        out.append(pc.binary_join(lists, b""))
    return out


def transform_batch(b: pa.RecordBatch, rate: int, spm_rate: int) -> pa.RecordBatch:
    """Columns ``doc_id, text, h1..h4`` -> ``_SCHEMA``."""
    text = b.column("text")
    units = split_units(text)
    n = pc.cast(pc.list_value_length(units), pa.int64())
    room = pc.add(n, 1)
    one, two = _mod(b.column("h1"), room), _mod(b.column("h2"), room)
    cut = pc.and_(pc.less(_mod(b.column("h3"), 100), rate), pc.greater(n, 0))
    cut = pc.and_(cut, pc.invert(pc.match_substring_regex(text, pattern=SENTINELS)))
    first = pc.min_element_wise(one, two).filter(cut)
    prefix, middle, suffix = _pieces(units.filter(cut), first, pc.max_element_wise(one, two).filter(cut))
    spm = pc.less(_mod(b.column("h4").filter(cut), 100), spm_rate)
    empty = b""
    made = pc.if_else(spm, pc.binary_join_element_wise(b"<S>", suffix, b"<P>", prefix, b"<M>", middle, empty),
                      pc.binary_join_element_wise(b"<P>", prefix, b"<S>", suffix, b"<M>", middle, empty))
    form = pc.if_else(spm, "spm", "psm")

    def put(values, rest):
        """``values`` at the transformed rows, ``rest`` elsewhere."""
        return pc.replace_with_mask(rest, cut, values)

    none = pa.nulls(len(text), pa.int64())
    return pa.RecordBatch.from_arrays([
        b.column("doc_id"), n, put(form, pa.repeat(pa.scalar("plain"), len(text))),
        put(pc.cast(pc.utf8_length(prefix.cast(pa.string())), pa.int64()), none),
        put(pc.cast(pc.utf8_length(middle.cast(pa.string())), pa.int64()), none),
        put(made.cast(pa.string()), text)], schema=_SCHEMA)


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256('<seed>:<id>') as integers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row.

    Units are blanks followed by a word, or the blanks that end a text. Two draws
    of the id's hash cut the units into prefix, middle and suffix; ``rate`` in a
    hundred texts are transformed, the others (and empty texts and texts that
    hold a sentinel) stay ``plain``, with null piece lengths. Equal ids draw
    alike; a null id draws as the empty string; null texts count as empty;
    repeated rows are each transformed; an empty table gives no rows; other
    columns, whatever their names, are left behind. Rows are dealt to the
    pipeline in blocks of 4 MB or one text; a very long text takes about fifteen
    times its size and must stay under 1 GB with its marks (Arrow's offsets).
    Map-only: no row moves."""
    def run(batches):
        for b in blocks(batches):
            yield transform_batch(b, rate, spm_rate)

    rows = keyed_text(docs, id_col, text_col).select("doc_id", "text", *_draws(F.col("doc_id"), seed))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                                "output string")


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form; a transformed output holds each
    sentinel once, as texts with one stay plain."""
    p = F.split(output, SENTINELS, -1)
    return F.when(form == "plain", output) \
        .when(form == "psm", F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))) \
        .otherwise(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1))))


def op12_arrow_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = rf"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
d AS (
  SELECT *, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(u) + 1) AS h1,
         ('0x' || substr(x, 9, 8))::BIGINT % (len(u) + 1) AS h2,
         CASE WHEN text = '' OR regexp_matches(text, '{SENTINELS}') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= {RATE}
              THEN 'plain' WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(h1, h2)], '') AS a,
         array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS b,
         array_to_string(u[greatest(h1, h2) + 1:], '') AS c FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b
            ELSE '<P>' || a || '<S>' || c || '<M>' || b END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN output ELSE a || b || c END) AS restored_sha256
FROM o
"""
