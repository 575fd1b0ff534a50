"""A relation graph of chunks as two tables, nodes and edges.

Edges are unique by (src, dst). A reference to another source is one edge to a node of that source and not to each of its chunks: the chunks of a
source are its membership, and walks and components go on through it, so nothing is lost and nothing multiplies. Entities that more than COMMON chunks have are ignored, which
bounds the pairs of one entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import entities, normal_entity
from lorespark.operators.skew import attach_by_key, small_side
from lorespark.plans.durable import durable

COMMON, LEAST_SHARED, LEAST_NAME = 50, 2, 4
SOURCE = "source:"  # what the node of a source begins with
VARIANTS_A_PASS = 200_000


def parent_edges(chunks: DataFrame) -> DataFrame:
    """Parent to child. A parent that is absent is a node without attributes."""
    child = chunks.where("chunk_type = 'child' AND parent_id IS NOT NULL")
    return child.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("parent_of").alias("relation"), F.lit(None).cast("bigint").alias("weight"))


def neighbour_edges(chunks: DataFrame) -> DataFrame:
    """Both ways between chunks that follow each other in their source. ``chunks`` has ``place``, unique in the source.

    The order of a source is cut into ranges first: a source that owns a third of all rows is sorted by many tasks, and only the
    ends of the ranges meet in the second step.
    """
    span = 10_000
    placed = chunks.where("source_name IS NOT NULL").select("source_name", "id", "place", F.floor(F.col("place") / span).alias("range"))
    inside = Window.partitionBy("source_name", "range").orderBy("place")
    following = placed.withColumn("next", F.lead("id").over(inside))
    pairs = following.where("next IS NOT NULL").select("id", "next")
    ends = placed.groupBy("source_name", "range").agg(F.min(F.struct("place", "id")).alias("a"), F.max(F.struct("place", "id")).alias("z"))
    across = Window.partitionBy("source_name").orderBy("range")
    joints = ends.select(F.col("z.id").alias("id"), F.lead("a.id").over(across).alias("next")).where("next IS NOT NULL")
    one_way = pairs.unionByName(joints)
    both = one_way.select(F.col("id").alias("src"), F.col("next").alias("dst")).unionByName(one_way.select(F.col("next").alias("src"), F.col("id").alias("dst")))
    return both.select("src", "dst", F.lit("same_source").alias("relation"), F.lit(None).cast("bigint").alias("weight"))


def shared_entity_edges(chunks: DataFrame, least: int = LEAST_SHARED, common: int = COMMON) -> DataFrame:
    """Both ways between chunks that share at least ``least`` entities; the weight is how many."""
    held = chunks.where("text IS NOT NULL").select("id", F.explode(entities(F.col("text"))).alias("entity")).distinct()
    rare = held.groupBy("entity").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= common)).select("entity")
    kept = held.join(rare, "entity")
    pairs = kept.withColumnRenamed("id", "a").join(kept.withColumnRenamed("id", "b"), "entity").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    strong = pairs.where(F.col("weight") >= least)
    both = strong.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(strong.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    return both.select("src", "dst", F.lit("shared_entities").alias("relation"), "weight")


def source_variants(names: DataFrame) -> DataFrame:
    """(variant, source_name): the spellings by which a text may name a source: lower case or normalised, whole or without its ending,
    and its ``alias``, if ``names`` has one.

    Of several sources with one variant the smallest name counts.
    """
    stem = F.regexp_replace("source_name", r"(?<=.)\.[^.]+$", "")
    alias = [F.lower("alias")] if "alias" in names.columns else []
    spelt = F.array(F.lower("source_name"), F.lower(stem), normal_entity(F.col("source_name")), normal_entity(stem), *alias)
    out = names.where("source_name IS NOT NULL").select("source_name", F.explode(spelt).alias("variant")).where(F.char_length("variant") >= LEAST_NAME)
    return out.groupBy("variant").agg(F.min("source_name").alias("source_name"))


def source_references(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(id, names_source): chunks whose text holds a spelling of another source's name.

    All spellings are looked for in one reading of the text, VARIANTS_A_PASS of them at a time.
    """
    variants = durable(source_variants(names))
    n = max(1, -(-variants.count() // VARIANTS_A_PASS))
    texts = chunks.where("text IS NOT NULL").select("id", "source_name", F.lower("text").alias("low"))
    found = None
    for part in range(n):
        listed = variants.where(F.pmod(F.xxhash64("variant"), F.lit(n)) == part).toPandas()  # at most about VARIANTS_A_PASS names

        def run(batches: Iterator[pd.DataFrame], listed: pd.DataFrame = listed) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for variant, name in listed.itertuples(index=False):
                machine.add_word(variant, name)
            machine.make_automaton()
            for batch in batches:
                rows = [(i, name) for i, own, low in batch.itertuples(index=False) for name in ({x for _, x in machine.iter(low)} if len(machine) else ()) if name != own]
                yield pd.DataFrame(rows, columns=["id", "names_source"])

        one = texts.mapInPandas(run, "id STRING, names_source STRING")
        found = one if found is None else found.unionByName(one).distinct()
    return found


def members(chunks: DataFrame) -> DataFrame:
    """(src, dst): from the node of each source to its chunks."""
    return chunks.where("source_name IS NOT NULL").select(F.concat(F.lit(SOURCE), "source_name").alias("src"), F.col("id").alias("dst"))


def all_edges(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, relation, weight), unique by (src, dst), weight 0 for all but shared_entities. A reference is an edge to the node of its source, and
    between two chunks it wins over parent_of, same_source and shared_entities."""
    pairs = parent_edges(chunks).unionByName(neighbour_edges(chunks)).unionByName(shared_entity_edges(chunks))
    order = F.element_at(F.create_map(F.lit("parent_of"), F.lit(1), F.lit("same_source"), F.lit(2), F.lit("shared_entities"), F.lit(3)), F.col("relation"))
    best = pairs.groupBy("src", "dst").agg(F.min(F.struct(order.alias("order"), "relation", "weight")).alias("e")).select("src", "dst", "e.relation", "e.weight")
    dst_source = chunks.select(F.col("id").alias("dst"), F.col("source_name").alias("names_source"))
    references = durable(source_references(chunks, names))
    named = references.select(F.col("id").alias("src"), "names_source", F.lit(True).alias("named"))
    joined = best.join(dst_source, "dst", "left").join(named, ["src", "names_source"], "left")
    relation = F.when(F.col("named"), F.lit("cross_reference")).otherwise(F.col("relation"))
    between = joined.select("src", "dst", relation.alias("relation"), F.when(F.col("named").isNull(), F.coalesce("weight", F.lit(0))).otherwise(0).alias("weight"))
    to_source = references.select(F.col("id").alias("src"), F.concat(F.lit(SOURCE), "names_source").alias("dst"), F.lit("cross_reference").alias("relation"), F.lit(0).cast("bigint").alias("weight"))
    return between.unionByName(to_source)


def related(edges: DataFrame, seeds: DataFrame, hops: int = 2, relation: str | None = None, belongs: DataFrame | None = None) -> DataFrame:
    """(id, dist): chunks within ``hops`` of any seed (a table with ``id``), without the seeds; unknown seeds give nothing.

    With ``belongs`` (from :func:`members`) a reference to a source reaches all its chunks in one hop; every source is met once.
    """
    used = (edges.where(F.col("relation") == relation) if relation else edges).select("src", "dst")
    reached = seeds.select("id").distinct().withColumn("dist", F.lit(0))
    front = reached
    for hop in range(1, hops + 1):
        step = used.join(small_side(front.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct()
        if belongs is not None:
            step = durable(step)
            sources = step.where(F.col("id").startswith(SOURCE)).select(F.col("id").alias("src"))
            step = step.union(belongs.join(small_side(sources), "src").select("dst")).distinct()
        step = step.where(~F.col("id").startswith(SOURCE))
        front = durable(step.join(reached.select("id"), "id", "left_anti").withColumn("dist", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached.where("dist > 0")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest node that each node is connected with, regardless of direction.

    Every round a node takes the smallest label around it and then that label's own label, so a chain of n nodes needs about log n rounds. A hub
    and a component that own a large share of the rows stay spread over all tasks (:func:`attach_by_key`).
    """
    both = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degrees = durable(both.groupBy("dst").agg(F.count("*").alias("degree")))
    labels = durable(nodes.select("id").union(both.select("src")).distinct().withColumn("component", F.col("id")))
    n_edges, n_nodes = both.count(), labels.count()
    while True:
        known = degrees.join(labels.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst")
        seen = attach_by_key(both, known, "dst", "degree", n_edges).groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        hooked = durable(labels.join(seen, "id", "left").select("id", "component", F.least("component", "c").alias("new")))
        # what a node's label has learnt is learnt by all that carry the label
        told = hooked.groupBy("component").agg(F.min("new").alias("told"), F.count("*").alias("n"))
        jumped = durable(attach_by_key(hooked, told, "component", "n", n_nodes).select("id", F.least("new", "told").alias("one"), "component"))
        carriers = jumped.groupBy("one").agg(F.count("*").alias("n"))
        own = jumped.select(F.col("id").alias("one"), F.col("one").alias("two")).join(carriers, "one")
        new = durable(attach_by_key(jumped, own, "one", "n", n_nodes).select("id", F.least("one", "two").alias("component"), F.col("component").alias("old")))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels
