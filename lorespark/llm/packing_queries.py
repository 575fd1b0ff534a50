"""Queries of problem 7: documents in containers of 2048 tokens, in windows of 2048, 1024 and 512."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.packing import WINDOWS, pack, piece_texts, with_sizes
from lorespark.plans.durable import durable
from lorespark.sources.tables import table

CAPACITY = WINDOWS[0]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(durable(with_sizes(_docs(spark, d))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that were divided."""
    return p7_packed(spark, d).where("piece_no = 2").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """What each container holds and how much room is unused."""
    return p7_packed(spark, d).groupBy("container_id", "step_group").agg(
        F.count("*").alias("items"), F.sum("n_tokens").alias("used"), (F.lit(CAPACITY) - F.sum("n_tokens")).alias("unused")
    )


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each step group's containers, tokens and share of unused room, and what of it came from a shorter tier than its window."""
    by = p7_packed(spark, d).groupBy("step_group").agg(
        F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("used"), F.sum(F.when(F.col("tier") < F.col("window"), F.col("n_tokens")).otherwise(0)).alias("filled_from_shorter")
    )
    return by.withColumn("unused_share", 1 - F.col("used") / (F.col("containers") * CAPACITY))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the pieces of divided documents."""
    return piece_texts(_docs(spark, d), durable(with_sizes(_docs(spark, d))), CAPACITY)


QUERIES = {"p7_found": p7_found, "p7_packed": p7_packed, "p7_containers": p7_containers, "p7_groups": p7_groups, "p7_pieces": p7_pieces}
SQL: dict[str, str] = {}
