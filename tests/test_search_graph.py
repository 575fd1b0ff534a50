from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph as G
from lorespark.operators import search as S
from lorespark.operators.skew import attach_by_key

CHUNKS = "id STRING, text STRING, source_name STRING, chunk_type STRING, parent_id STRING, place BIGINT"


def edges(df):
    return {(r.src, r.dst, r.relation) for r in df.collect()}


def test_parent_and_neighbours(spark):
    chunks = spark.createDataFrame([("p", "x", "s", "parent", None, 1), ("c1", "x", "s", "child", "p", 2), ("c2", "x", "s", "child", "p", 20_001), ("o", "x", None, None, None, 3)], CHUNKS)
    assert edges(G.parent_edges(chunks)) == {("p", "c1", "parent_of"), ("p", "c2", "parent_of")}
    assert {(r.src, r.dst) for r in G.neighbour_edges(chunks).collect()} == {("p", "c1"), ("c1", "p"), ("c1", "c2"), ("c2", "c1")}


def test_shared_entities_and_references(spark):
    rows = [("e1", "The Payment Gateway and Credit Card and Checkout Flow", "a.md", None, None, 1), ("e2", "A Payment Gateway, Credit Card, Checkout Flow; see login_spec", "b.md", None, None, 2), ("e3", "nothing", "login_spec.md", None, None, 3)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    shared = {(r.src, r.dst, r.weight) for r in G.shared_entity_edges(chunks).collect()}
    assert shared == {("e1", "e2", 3), ("e2", "e1", 3)}
    named = {tuple(r) for r in G.source_references(chunks, chunks.select("source_name")).collect()}
    assert named == {("e2", "login_spec.md")}
    assert G.all_edges(chunks, chunks.select("source_name")).groupBy("src", "dst").count().where("count > 1").isEmpty()


def test_related_and_components(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("a", "d", "x")], "src STRING, dst STRING, relation STRING")
    seeds = spark.createDataFrame([("a",)], "id STRING")
    assert {tuple(r) for r in G.related(e, seeds, 1, "r").collect()} == {("b", 1)}
    assert {tuple(r) for r in G.related(e, seeds, 2).collect()} == {("b", 1), ("d", 1), ("c", 2)}
    assert G.related(e, spark.createDataFrame([("zz",)], "id STRING")).collect() == []
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "src STRING, dst STRING")
    nodes = spark.createDataFrame([("alone",)], "id STRING")
    assert {(r.component) for r in G.components(chain, nodes).collect()} == {"000", "alone"}


def test_bm25_matches_formula(spark):
    docs = spark.createDataFrame([("d1", "red red fox"), ("d2", "blue fox"), ("d3", "green owl sits"), ("d4", None)], "id STRING, text STRING")
    q = spark.createDataFrame([(1, "red fox fox")], "query_id BIGINT, query STRING")
    got = {r.id: r.score for r in S.bm25(q, docs, "id", "text").collect()}
    n, mean = 4, 8 / 4
    raw = {"red": math.log(3.5) - math.log(1.5), "fox": math.log(2.5) - math.log(2.5)}
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert n == 4 and got["d1"] == pytest.approx(raw["red"] * part(2, 3) + 2 * raw["fox"] * part(1, 3)) and "d3" not in got


def test_dense_leaves_out_unusable(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [1.0]), ("f", [2.0, 0.1])], "id STRING, v ARRAY<FLOAT>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id BIGINT, vector ARRAY<FLOAT>")
    assert [r.id for r in S.top_k(S.dense_scores(q, docs, "id", "v", 2, 5), 5).orderBy("rank").collect()] == ["a", "f"]


def test_parents_for_children(spark):
    chunks = spark.createDataFrame([("p", None, None), ("c1", "child", "p"), ("c2", "child", "p"), ("x", "child", "gone"), ("f", None, None)], "id STRING, chunk_type STRING, parent_id STRING")
    ranked = spark.createDataFrame([(1, "c2", 0.5, 1), (1, "x", 0.4, 2), (1, "c1", 0.9, 3), (1, "f", 0.1, 4)], "query_id BIGINT, id STRING, score DOUBLE, rank INT")
    assert [(r.id, r.score) for r in S.parents_for_children(ranked, chunks).orderBy("rank").collect()] == [("p", 0.9), ("x", 0.4), ("f", 0.1)]


def test_attach_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("fact", F.upper("k"))
    out = attach_by_key(rows, facts, "k", "n", 3000)
    assert out.count() == 3000 and out.where("fact <> upper(k)").isEmpty()
    assert attach_by_key(rows.limit(0), facts, "k", "n", 0).isEmpty()


def test_references_lead_through_the_source(spark):
    rows = [("x1", "guide.md", "please read the Handbook", 1, None, None), ("x2", "handbook.pdf", "one", 2, None, None), ("x3", "handbook.pdf", "two", 3, None, None), ("x4", "other.md", None, 4, None, None)]
    chunks = spark.createDataFrame(rows, "id STRING, source_name STRING, text STRING, place BIGINT, chunk_type STRING, parent_id STRING")
    edges = G.all_edges(chunks, chunks.select("source_name", F.lit("acme").alias("alias")).distinct())
    got = {tuple(r) for r in edges.where("relation = 'cross_reference'").select("src", "dst").collect()}
    assert got == {("x1", "source:handbook.pdf")}
    seeds = spark.createDataFrame([("x1",)], "id STRING")
    assert {(r.id, r.dist) for r in G.related(edges, seeds, 2, belongs=G.members(chunks)).collect()} == {("x2", 1), ("x3", 1)}
    assert G.related(edges, seeds, 2, "parent_of", G.members(chunks)).isEmpty()


def test_components_with_a_hub(spark):
    star = spark.range(3000).select(F.lit("a").alias("src"), F.concat(F.lit("n"), "id").alias("dst"))
    out = G.components(star, spark.createDataFrame([("zz",)], "id STRING"))
    assert {tuple(r) for r in out.groupBy("component").count().collect()} == {("a", 3001), ("zz", 1)}


def test_written_index_equals_all_pairs(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    texts = [(f"d{i:03}", " ".join(r.choices("abcdefghijklmnop", k=r.randrange(0, 30))) or None) for i in range(300)] + [(None, "a b"), ("e", "")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "id STRING, text STRING, terms STRING")
    q = spark.createDataFrame([(i, " ".join(r.choices("abcdefghijklmnopqz", k=6))) for i in range(12)] + [(90, ""), (91, None)], "query_id BIGINT, query STRING")
    folder = f"file://{tmp_path}/index"
    S.write_index(docs, "id", "text", folder)
    every = {(x.query_id, x.id): x.score for x in S.bm25(q, docs.where("id IS NOT NULL"), "id", "text").collect()}
    monkeypatch.setattr(S, "QUERIES_A_BLOCK", 5)
    monkeypatch.setattr(S, "SCORES_AT_ONCE", 100)
    got = {(x.query_id, x.id): x.score for x in S.bm25_top(q, folder, 7).collect()}
    for n in {k for k, _ in every}:
        best = sorted(((round(-s, 6), i) for (k, i), s in every.items() if k == n))[:7]
        assert [round(-got[n, i], 6) for _, i in best] == [s for s, _ in best]
    assert len(got) == sum(min(7, sum(k == n for k, _ in every)) for n in {k for k, _ in every})
    pairs = spark.createDataFrame([(0, "d001"), (3, "d200"), (3, "nobody")], "query_id BIGINT, id STRING")
    assert all(x.score == pytest.approx(every[x.query_id, x.id]) for x in S.bm25_of(pairs, q, folder).collect())
    S.write_index(docs.limit(0), "id", "text", folder)
    assert S.bm25_top(q, folder, 7).isEmpty()


def test_graph_expansion(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("a", "source:s")], "src STRING, dst STRING")
    belongs = spark.createDataFrame([("source:s", "z"), ("source:s", "a")], "src STRING, dst STRING")
    ranked = spark.createDataFrame([(1, "a", 0.9, 1), (1, "c", 0.5, 2), (2, "q", 0.4, 1)], "query_id BIGINT, id STRING, score DOUBLE, rank INT")
    got = {tuple(r) for r in S.expanded(ranked, edges, belongs, 2).collect()}
    assert got == {(1, "a", 0.9, 1), (1, "c", 0.5, 2), (1, "b", 0.0, 3), (1, "z", 0.0, 4), (2, "q", 0.4, 1)}


def test_models_of_the_caller(spark):
    docs = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "y")], "id STRING, text STRING")
    assert {(r.id, tuple(r.vector)) for r in S.embedded(docs, "id", "text", lambda texts: [[float(len(t))] for t in texts]).collect()} == {("a", (2.0,)), ("c", (1.0,))}
    ranked = spark.createDataFrame([(1, "a", 0.1, 1), (1, "b", 0.1, 2), (1, "c", 0.1, 3)], "query_id BIGINT, id STRING, score DOUBLE, rank INT")
    q = spark.createDataFrame([(1, "ask")], "query_id BIGINT, query STRING")
    out = S.reranked(ranked, q, docs, "id", "text", 2, lambda qs, ts: [float(t == "y") + len(t) / 100 for t in ts])
    assert [r.id for r in out.orderBy("rank").collect()] == ["c", "a"]
    assert S.top_k(ranked, -1).count() == 3 and [S.clamped(k) for k in (-1, 0, 7, 99)] == [-1, 1, 7, 20]
