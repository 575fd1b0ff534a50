"""Queries of problem 6: test cases that differ in formatting only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import ledger as L
from lorespark.plans.durable import durable, shared_dir
from lorespark.sources.tables import table

FIELDS = ["use_case", "test_case"]
BUCKETS = 16  # some ten thousand keys each at SCALE 1


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Records with their keys; a delivery is half a year of ``created_at``, rows without a date come first."""
    half = F.year("created_at") * 2 + F.when(F.month("created_at") > 6, 1).otherwise(0)
    return durable(L.keyed(table(spark, d, "test_cases", "case_id", "created_at", *FIELDS), "case_id", FIELDS, half))


def _ledger(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    return L.feed_all(L.Ledger(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}", BUCKETS), rows)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return L.copies_of(rows, _ledger(rows))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per group with its number of copies."""
    kept = _ledger(_rows(spark, d)).select(F.col("keep_id").alias("case_id"), "copies")
    return table(spark, d, "test_cases", "case_id", *FIELDS).join(kept, "case_id")


QUERIES = {"p6_found": p6_found, "p6_collapsed": p6_collapsed}

_KEYED = r"""
WITH parts AS (
  SELECT case_id, use_case, test_case,
         regexp_replace(lower(replace(upper(use_case), 'ß', 'SS')), '[^\p{L}\p{N}]+', '', 'g') AS a,
         regexp_replace(lower(replace(upper(test_case), 'ß', 'SS')), '[^\p{L}\p{N}]+', '', 'g') AS b
  FROM test_cases),
grouped AS (
  SELECT case_id, use_case, test_case, min(case_id) OVER g AS keep_id, count(*) OVER g AS copies
  FROM parts WHERE a <> '' AND b <> ''
  WINDOW g AS (PARTITION BY least(a, b), greatest(a, b)))
"""

SQL = {
    "p6_found": _KEYED + "SELECT keep_id, case_id AS copy_id FROM grouped WHERE case_id <> keep_id",
    "p6_collapsed": _KEYED + "SELECT case_id, use_case, test_case, copies FROM grouped WHERE case_id = keep_id",
}
