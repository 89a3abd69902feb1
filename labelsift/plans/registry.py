"""All registered queries and their oracle SQL, merged from the plan modules."""

from __future__ import annotations

from labelsift.plans import io_queries, model_queries, run_queries, signal_queries, screen_queries, text_queries, trust_queries

_MODULES = [screen_queries, text_queries, run_queries, model_queries, io_queries,
            signal_queries, trust_queries]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
