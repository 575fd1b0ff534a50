"""Queries of problem 9: personal information in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.pii import pii_spans, redacted
from lorespark.sources.tables import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    spans = pii_spans(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "known_names"))
    return spans.select("doc_id", "pii_type", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders."""
    return redacted(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "known_names"))


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
SQL: dict[str, str] = {}
