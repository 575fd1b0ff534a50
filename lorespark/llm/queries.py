"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lorespark.llm import history_queries, leak_queries, ledger_queries, packing_queries, page_queries, pii_queries, repeat_queries, split_queries, vector_queries

MODULES = (ledger_queries, split_queries, packing_queries, vector_queries, history_queries, leak_queries, repeat_queries, pii_queries, page_queries)
QUERIES: dict = {}
SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
