"""Queries of problem 8: documents that hold passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.leaks import leaks
from lorespark.sources.tables import table


def p8_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that leaks by its alignment: whole, partial, edited and paraphrased copies, with their scores."""
    found = leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"))
    return found.where("leaked").drop("leaked")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Of these, the pairs that share WINDOW words in a row, or the whole of a shorter item."""
    return p8_aligned(spark, d).where(F.col("longest_run") >= F.col("needed")).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_aligned": p8_aligned}

_WORDS = r"list_filter(regexp_split_to_array(lower(replace(upper(text), 'ß', 'SS')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
SQL = {
    "p8_found": f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
need AS (
  SELECT item_id, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
have AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM need) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM have JOIN need USING (n, g)"""
}
