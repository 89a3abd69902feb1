"""Pre-tokens of the public byte-level vocabularies."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import regex

_UNASSIGNED = chr(0x378)
# The same pattern over ASCII, for the faster standard matcher.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


@lru_cache(maxsize=1)
def _rules():
    """The pattern, and the letters and digits that only a newer Unicode
    version than the tokenizers' assigns: to them these are neither. A letter
    after an exclamation mark is a pre-token of its own."""
    import public_tokenizers
    from tokenizers.pre_tokenizers import ByteLevel

    word = regex.compile(r"[\p{L}\p{N}]")
    known = [c for c in map(chr, range(128, sys.maxunicode + 1)) if word.match(c)]
    spans = ByteLevel(add_prefix_space=False).pre_tokenize_str("".join("!" + c for c in known))
    alone = {i for _, (i, j) in spans if j - i == 1}
    new = frozenset(c for k, c in enumerate(known) if 2 * k + 1 not in alone)
    return regex.compile(public_tokenizers.PATTERN), new, {ord(c): _UNASSIGNED for c in new}


def pretokens(text: str) -> list[str]:
    """``text`` cut into pre-tokens; joined they are the text again."""
    if text.isascii():
        return _ASCII.findall(text)
    find, new, table = _rules()
    if new.isdisjoint(text):
        return find.findall(text)
    return [text[m.start():m.end()] for m in find.finditer(text.translate(table))]
