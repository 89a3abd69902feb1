"""Scalar column helpers. All are plain ``pyspark.sql.functions`` compositions,
so they stay inside whole-stage codegen and have a one-line DuckDB twin
(given in each docstring, used by the oracle SQL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading / trailing runs of whitespace or Unicode separators (tab, newline,
# NBSP, ideographic space ...). Spark's trim() removes only ASCII spaces.
_EDGE_WS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


# Fixed value: what a display shows for an absent value.
DASH = "—"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_empty(col) -> Column:
    """Null -> '' and cast to string. SQL: ``coalesce(CAST(x AS VARCHAR), '')``."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def strip_ws(col) -> Column:
    """P6 strip. SQL: ``regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')``."""
    return F.regexp_replace(_c(col), _EDGE_WS, "")


def nonblank(col) -> Column:
    """P6 predicate: text (null treated as '') still has content after strip."""
    return strip_ws(text_or_empty(col)) != F.lit("")


def hash60(seed, key) -> Column:
    """H1: a 60-bit non-negative integer from ``md5('<seed>:<key>')``.

    Identical in DuckDB as ``('0x' || substr(md5(seed || ':' || key), 1, 15))::BIGINT``.
    Used for every seeded draw (sampling, splits, forest sub-samples), so a
    draw depends only on (seed, key) -- never on partitioning or row order.
    """
    s = F.concat(F.lit(f"{seed}:") if not isinstance(seed, Column) else F.concat(seed.cast("string"), F.lit(":")),
                 _c(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def safe_div(a, b) -> Column:
    """A8/A10 zero-division rule: ``coalesce(try_divide(a, b), 0.0)``."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def num(col, default: float = 0.0) -> Column:
    """Safe numeric coercion with a default: ``coalesce(try_cast(x AS DOUBLE), d)``."""
    return F.coalesce(_c(col).try_cast("double"), F.lit(float(default)))


def pct(col) -> Column:
    """Percent normaliser for display: a fraction (|x| <= 1) becomes points."""
    x = num(col)
    return F.when(F.abs(x) <= 1, x * 100).otherwise(x)


def fmt_num(col, decimals: int = 2) -> Column:
    """Number with thousands separators and ``decimals`` places."""
    return F.format_number(num(col), decimals)


def fmt_pct(col, decimals: int = 1) -> Column:
    """Percentage points (see ``pct``) with ``decimals`` places and a sign."""
    return F.format_string(f"%.{decimals}f%%", pct(col))


def fmt_mb(col) -> Column:
    """Bytes as megabytes with two places; a dash for zero or null."""
    return F.when(num(col) > 0, F.format_string("%.2f MB", num(col) / (1 << 20))).otherwise(F.lit(DASH))


def truncate_display(col, width: int = 180) -> Column:
    """Texts longer than ``width`` become the first ``width-3`` chars + '...'."""
    c = _c(col).cast("string")
    return F.when(F.char_length(c) > width,
                  F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
