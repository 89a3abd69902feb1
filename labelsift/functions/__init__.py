"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from labelsift.functions.columns import (
    hash60, nonblank, num, pct, safe_div, strip_ws, text_or_empty, truncate_display,
)
from labelsift.functions.stopwords import ENGLISH_STOP_WORDS

__all__ = [
    "ENGLISH_STOP_WORDS", "hash60", "nonblank", "num", "pct", "safe_div",
    "strip_ws", "text_or_empty", "truncate_display",
]
