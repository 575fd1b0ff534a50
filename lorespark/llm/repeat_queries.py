"""Queries of problem 3: lines that recur across a source's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.repeats import by_letters, repeated_lines, without_lines
from lorespark.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents", "raw_id", "source_name", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The occurrences in repeated clusters whose letters recur often enough themselves."""
    return by_letters(repeated_lines(_docs(spark, d))).select("raw_id", "line_no")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each text without the lines of p3_found."""
    docs = _docs(spark, d).where("source_name IS NOT NULL AND text IS NOT NULL")
    return without_lines(docs, by_letters(repeated_lines(_docs(spark, d)))).select("raw_id", "text", "removed")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each text without all lines of repeated clusters: bylines with changing names and edited notices go too."""
    docs = _docs(spark, d).where("source_name IS NOT NULL AND text IS NOT NULL")
    return without_lines(docs, repeated_lines(_docs(spark, d))).select("raw_id", "text", "removed")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_clusters": p3_clusters}

_LINES = r"""
WITH l AS (
  SELECT raw_id, source_name, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM raw_documents WHERE source_name IS NOT NULL AND text IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(replace(upper(line), 'ß', 'SS')), '[^\p{L}]+', '', 'g') AS letters FROM l),
n AS (SELECT source_name, count(*) AS n FROM raw_documents WHERE source_name IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
r AS (
  SELECT source_name, letters FROM k JOIN n USING (source_name) WHERE letters <> '' GROUP BY source_name, letters, n
  HAVING count(DISTINCT raw_id) >= 5 AND count(DISTINCT raw_id) >= 0.1 * n)
"""
SQL = {
    "p3_found": _LINES + "SELECT raw_id, line_no FROM k JOIN r USING (source_name, letters)",
    "p3_clean": _LINES
    + """SELECT raw_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (r.letters IS NULL), '') AS text,
  count(r.letters) AS removed FROM k LEFT JOIN r USING (source_name, letters) GROUP BY raw_id""",
}
