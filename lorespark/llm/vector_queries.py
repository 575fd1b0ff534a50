"""Queries of problem 4: the most similar chunks by embedding."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.vectors import nearest, usable_vectors
from lorespark.sources.tables import table

DIM, K = 96, 5
MOST_LISTS = 65_536  # reached at 4.3 thousand million rows


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return usable_vectors(table(spark, d, "knowledge_chunks", "id", "batch_no", "pos", "embedding"), "id", ["batch_no", "pos"], "embedding", DIM)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 0.85 where one is among the other's five most similar; as many lists as the square root of the rows."""
    rows = table(spark, d, "knowledge_chunks", "id").count()
    near = nearest(_vectors(spark, d), DIM, K, lists=min(MOST_LISTS, max(1, round(math.sqrt(rows)))), spread=8, floor=0.85, eps=4.0)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def p4_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every vector whose position is divisible by 100, against all rows."""
    return nearest(_vectors(spark, d), DIM, K, lists=1, spread=1, eps=3.0, asking="pos.pos % 100 = 0")


QUERIES = {"p4_found": p4_found, "p4_top5": p4_top5}
SQL = {
    "p4_found": """
WITH v AS (
  SELECT id, any_value(embedding::DOUBLE[96]) AS e FROM knowledge_chunks
  WHERE id IS NOT NULL AND len(embedding) = 96
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
  GROUP BY id),
p AS (
  SELECT a.id, b.id AS other, round(array_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS n FROM p WHERE c >= 0.85)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE n <= 5"""
}
