"""From documents to a searchable store, and from a store to generated cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import modeljson as J
from lorespark.functions.text import clean_text
from lorespark.operators import graph as G
from lorespark.operators import search as S
from lorespark.operators.chunking import parent_child_chunks

DIM = 256
#: A model: a prompt in, a reply out. It is called in the tasks, so it must be picklable or open its connection there.
Generator = Callable[[str], str]


def ingest(docs: DataFrame, folder: str) -> None:
    """Documents (doc_id, text, source_name, source_type) to tables of chunks, vectors, the text index and edges below ``folder``."""
    spark = docs.sparkSession
    parent_child_chunks(docs.withColumn("text", clean_text(F.col("text"))), "doc_id").write.mode("overwrite").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    S.hashed_vectors(chunks.where("chunk_type = 'child'"), "id", "text", DIM).write.mode("overwrite").parquet(f"{folder}/vectors")
    S.write_index(chunks.where("chunk_type = 'child'"), "id", "text", f"{folder}/index")
    placed = chunks.withColumn("place", F.col("pos"))
    G.all_edges(placed, chunks.select("source_name").distinct()).write.mode("overwrite").parquet(f"{folder}/edges")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank, text) for queries (query_id, query): children are searched, their parents come out."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    children = chunks.where("chunk_type = 'child'").join(spark.read.parquet(f"{folder}/vectors"), "id")
    own = S.hashed_vectors(queries, "query_id", "query", DIM).select(F.col("id").alias("query_id"), "vector")
    ranked = S.hybrid(queries.join(own, "query_id"), children, "id", "vector", DIM, f"{folder}/index", k)
    return S.parents_for_children(ranked, chunks).join(chunks.select("id", "text"), "id")


def replies(prompts: DataFrame, generate: Generator, attempts: int = 3) -> DataFrame:
    """(prompt_id, reply) of prompts (prompt_id, prompt); a failing call is tried again, then gives null and not an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            for _ in range(attempts):
                try:
                    return generate(prompt)
                except Exception:  # noqa: BLE001 - a provider may raise anything
                    continue
            return None

        for batch in batches:
            yield pd.DataFrame({"prompt_id": batch["prompt_id"], "reply": batch["prompt"].map(one)})

    return prompts.select("prompt_id", "prompt").mapInPandas(run, "prompt_id STRING, reply STRING")


def generated_cases(prompts: DataFrame, generate: Generator) -> DataFrame:
    """(prompt_id, pos, and the fields of a case): replies read, repaired and typed, in the order of the reply."""
    read = J.read_replies(replies(prompts, generate), "reply")
    parsed = read.select("prompt_id", F.posexplode_outer("cases").alias("pos", "one")).where("one IS NOT NULL")
    return J.typed_cases(parsed, "one").drop("one")
