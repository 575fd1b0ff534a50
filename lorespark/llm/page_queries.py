"""Queries of problem 1: furniture of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.pages import extract
from lorespark.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_documents", "raw_id", "text", "source_name", "source_type", "page_url").where("source_type = 'web_doc'")
    host = F.regexp_extract("page_url", r"^[a-z]+://([^/]+)", 1)
    return pages.withColumn("host", F.coalesce(F.nullif(host, F.lit("")), F.col("source_name")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return extract(_pages(spark, d), with_body=False).select("raw_id", F.explode(F.col("furniture").cast("array<bigint>")).alias("line_no"))


def p1_body(spark: SparkSession, d: str) -> DataFrame:
    """Every page's main body."""
    return extract(_pages(spark, d)).select("raw_id", "body", F.size("furniture").alias("removed"))


QUERIES = {"p1_found": p1_found, "p1_body": p1_body}
SQL: dict[str, str] = {}
