"""All queries of the catalogue and their SQL."""

from __future__ import annotations

from loomspark.plans import graph_queries, record_queries, search_queries, text_queries

PARTS = (text_queries, search_queries, graph_queries, record_queries)


def queries() -> dict:
    return {name: fn for part in PARTS for name, (fn, _) in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
