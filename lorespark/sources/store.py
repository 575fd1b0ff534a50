"""Writing chunks, manifests and suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.skew import first_rows
from lorespark.operators.suite import flattened
from lorespark.plans.durable import delete_folders


def with_default_ids(entries: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """Entries without an id are called after their position."""
    return entries.withColumn(id_col, F.coalesce(F.col(id_col), F.concat(F.lit("legacy-"), F.col(pos_col).cast("string"))))


def upserted(store: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The store after a batch: rows of the batch replace those with their key. Keys are unique in the batch."""
    return store.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; combined before the shuffle, so repeats of one key cost nothing."""
    return first_rows(rows, key, order, last=True).dropDuplicates([key])


def manifest(files: DataFrame, name_col: str, content_col: str) -> DataFrame:
    """(name, sha256, bytes) of contents, to be written beside them."""
    content = F.col(content_col).cast("binary")
    return files.where(F.col(content_col).isNotNull()).select(F.col(name_col).alias("name"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("bytes"))


def verified(files: DataFrame, written: DataFrame) -> DataFrame:
    """(name, state) of contents against a manifest: ok, tampered, missing (no content), malformed (no digest), unlisted."""
    state = (
        F.when(F.col("w.name").isNull(), "unlisted")
        .when(~F.coalesce(F.col("w.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed")
        .when(F.col("f.name").isNull(), "missing")
        .when(F.col("w.sha256") != F.col("f.sha256"), "tampered")
        .otherwise("ok")
    )
    joined = files.alias("f").join(written.alias("w"), F.col("f.name") == F.col("w.name"), "full_outer")
    return joined.select(F.coalesce("f.name", "w.name").alias("name"), state.alias("state"))


def export(cases: DataFrame, kind: str, folder: str) -> None:
    """Write a suite as JSON lines or as a flat CSV table."""
    kind = kind.strip().lower()
    if kind == "json":
        cases.write.mode("overwrite").json(folder)
    elif kind in ("csv", "excel"):
        flattened(cases).write.mode("overwrite").option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    else:
        raise ValueError(f"unknown export format: {kind}")


def save_graph(edges: DataFrame, nodes: DataFrame, folder: str) -> None:
    """Nodes and edges as tables below ``folder``, anew."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of a saved graph, or nothing where there is none."""
    parts = [f"{folder}/{part}" for part in ("nodes", "edges")]
    return tuple(map(spark.read.parquet, parts)) if all(exists(spark, p) for p in parts) else None


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON files, one document a file; edges stand under ``links`` or ``edges``. A file that can't be read gives none."""
    known = "id STRING"
    edge = "source STRING, target STRING, relation STRING, weight BIGINT"
    docs = spark.read.schema(f"nodes ARRAY<STRUCT<{known.replace(' ', ': ')}>>, links ARRAY<STRUCT<{_fields(edge)}>>, edges ARRAY<STRUCT<{_fields(edge)}>>").option("multiLine", True).json(path)
    nodes = docs.select(F.explode("nodes").alias("n")).select("n.id").where("id IS NOT NULL")
    edges = docs.select(F.explode(F.coalesce("links", "edges")).alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", "e.weight")
    return nodes, edges.where("src IS NOT NULL AND dst IS NOT NULL")


def _fields(ddl: str) -> str:
    return ", ".join(": ".join(part.split()) for part in ddl.split(", "))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def reset(spark: SparkSession, folder: str) -> None:
    """Delete a store, an index or a graph; one that isn't there is no error."""
    delete_folders(spark, folder)
