"""Registered queries of the core, by topic, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from lorespark.queries import graph_queries, retrieval_queries, source_queries, suite_queries, text_queries

_PARTS = (text_queries, retrieval_queries, graph_queries, suite_queries, source_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
