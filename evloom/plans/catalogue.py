"""All queries of the core by name."""

from __future__ import annotations

from . import gate_queries, nested_queries, record_queries, score_queries, source_queries, text_queries

MODULES = (nested_queries, text_queries, record_queries, score_queries, gate_queries, source_queries)
FLAGSHIP = "p7_kept"


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def sql() -> dict:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
