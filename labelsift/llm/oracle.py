"""DuckDB fragments shared by the oracles of the operators."""

from __future__ import annotations

# CRC-32 (reflected polynomial 0xEDB88320): the 256 remainders of one byte.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"""


def crc32_sql(text: str, table: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text``; ``table`` names the
    list of ``CRC_TABLE_SQL``."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), "
            f"4294967295), 4294967295)")
