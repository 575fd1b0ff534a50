"""Queries of problem 5: texts longer than their row in size_limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.splitting import split_oversized
from lorespark.operators.skew import first_rows
from lorespark.sources.tables import table


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces. A chunk sent again under its id is the same item: its first arrival counts."""
    limits = {r.item_kind: (r.max_size, r.overlap_size) for r in table(spark, d, "size_limits").collect()}  # a few rows of settings
    docs = table(spark, d, "raw_documents", "raw_id", "text")
    chunks = table(spark, d, "knowledge_chunks", "id", "batch_no", "pos", "text")
    chunks = chunks.where(F.char_length("text") > limits["knowledge_chunk"][0])
    chunks = first_rows(chunks, "id", ["batch_no", "pos"])
    return split_oversized(docs, "raw_document", F.col("raw_id"), F.col("text"), *limits["raw_document"]).unionByName(
        split_oversized(chunks, "knowledge_chunk", F.col("id"), F.col("text"), *limits["knowledge_chunk"])
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece_no = 1").select("item_kind", "item_id").distinct()


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item cover together, whether all fit, and whether each goes on where the one before ended."""
    limits = F.broadcast(table(spark, d, "size_limits").select("item_kind", "max_size", "overlap_size"))
    by_item = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")  # an item's own pieces
    pieces = p5_pieces(spark, d).join(limits, "item_kind").withColumn("before", F.lag("end_pos").over(by_item))
    fits = (F.char_length("text") <= F.col("max_size")) & (F.col("core_pos") - F.col("start_pos") <= F.col("overlap_size")) & (F.char_length("text") == F.col("end_pos") - F.col("start_pos") + 1)
    return pieces.groupBy("item_kind", "item_id").agg(
        F.sum(F.col("end_pos") - F.col("core_pos") + 1).alias("covered"), F.min(fits).alias("fits"), F.min(F.col("core_pos") == F.coalesce("before", F.lit(0)) + 1).alias("goes_on")
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_cover": p5_cover}
SQL = {
    "p5_cover": """
SELECT 'raw_document' AS item_kind, CAST(raw_id AS VARCHAR) AS item_id, length(text) AS covered, true AS fits, true AS goes_on FROM raw_documents
WHERE length(text) > (SELECT max_size FROM size_limits WHERE item_kind = 'raw_document')
UNION ALL SELECT 'knowledge_chunk', id, length(any_value(text)), true, true FROM knowledge_chunks
WHERE id IS NOT NULL AND length(text) > (SELECT max_size FROM size_limits WHERE item_kind = 'knowledge_chunk') GROUP BY id""",
    "p5_found": """
SELECT DISTINCT 'raw_document' AS item_kind, CAST(raw_id AS VARCHAR) AS item_id FROM raw_documents
WHERE length(text) > (SELECT max_size FROM size_limits WHERE item_kind = 'raw_document')
UNION SELECT DISTINCT 'knowledge_chunk', id FROM knowledge_chunks
WHERE id IS NOT NULL AND length(text) > (SELECT max_size FROM size_limits WHERE item_kind = 'knowledge_chunk')"""
}
