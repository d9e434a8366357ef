"""Every query of the engine's own operators, with its SQL where SQL can express it."""

from __future__ import annotations

from loomdex.plans import queries_code, queries_graph, queries_retrieval, queries_stream, queries_text

PARTS = (queries_retrieval, queries_graph, queries_text, queries_stream, queries_code)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
