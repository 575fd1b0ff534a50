"""The relation graph of the knowledge chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import graph as G
from lorespark.operators.skew import attach_by_key, first_rows
from lorespark.plans.durable import durable
from lorespark.sources.tables import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """First arrivals by id, with their place in the order of arrival."""
    rows = table(spark, d, "knowledge_chunks", "id", "batch_no", "pos", "text", "source_name", "source_type", "chunk_type", "parent_id")
    return first_rows(rows, "id", ["pos"]).withColumn("place", F.col("pos"))


def edges_parent(spark, d):
    return G.parent_edges(_chunks(spark, d)).select("src", "dst")


def edges_same_source(spark, d):
    return G.neighbour_edges(_chunks(spark, d)).select("src", "dst")


def edges_shared(spark, d):
    return G.shared_entity_edges(_chunks(spark, d)).select("src", "dst", "weight")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Sources by name, and by the first part of their site's host."""
    return table(spark, d, "doc_sources", "source_name", "site_host").select("source_name", F.substring_index("site_host", ".", 1).alias("alias"))


def edges_cross_ref(spark, d):
    return G.source_references(_chunks(spark, d), _names(spark, d))


def pages_cross_ref(spark, d):
    """Documents that name another source."""
    docs = table(spark, d, "raw_documents", "raw_id", "source_name", "text").withColumn("id", F.col("raw_id").cast("string"))
    return G.source_references(docs, _names(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.all_edges(_chunks(spark, d), _names(spark, d))


def edges_all(spark, d):
    return _edges(spark, d)


def bfs_2hop(spark, d):
    """From every chunk whose position is divisible by 100, over all relations."""
    chunks = durable(_chunks(spark, d))
    return G.related(durable(_edges(spark, d)), chunks.where("place % 100 = 0"), 2, belongs=G.members(chunks))


def _connected(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, component) of chunks, named by the smallest: neighbours in a source are connected through the source, and so is what names it."""
    ways = edges.where("relation <> 'same_source'").select("src", "dst").unionByName(G.members(chunks))
    found = durable(G.components(ways, chunks).where(~F.col("id").startswith(G.SOURCE)))
    names = durable(found.groupBy("component").agg(F.min("id").alias("name"), F.count("*").alias("n")))
    return attach_by_key(found, names, "component", "n", found.count()).select("id", F.col("name").alias("component"))


def graph_stats(spark, d):
    """Edges by relation, and nodes, edges and components in all. A parent that is absent is a node."""
    edges, chunks = durable(_edges(spark, d)), durable(_chunks(spark, d))
    found = durable(_connected(edges, chunks))
    count = lambda df, name: df.select(F.lit(name).alias("relation"), "n")
    return (
        edges.groupBy("relation").agg(F.count("*").alias("n"))
        .unionByName(count(edges.agg(F.count("*").alias("n")), "edges"))
        .unionByName(count(found.agg(F.count("*").alias("n")), "nodes"))
        .unionByName(count(found.agg(F.countDistinct("component").alias("n")), "components"))
    )


def graph_components(spark, d):
    return _connected(durable(_edges(spark, d)), durable(_chunks(spark, d)))


QUERIES = {f.__name__: f for f in (edges_parent, edges_same_source, edges_shared, edges_cross_ref, pages_cross_ref, edges_all, bfs_2hop, graph_stats, graph_components)}

_C = "WITH RECURSIVE c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS arrival FROM knowledge_chunks WHERE id IS NOT NULL) WHERE arrival = 1),"
_PARENT = "pe AS (SELECT parent_id AS src, id AS dst FROM c WHERE chunk_type = 'child' AND parent_id IS NOT NULL)"
_SAME = """
n AS (SELECT id, lead(id) OVER (PARTITION BY source_name ORDER BY pos) AS nxt FROM c WHERE source_name IS NOT NULL),
se AS (SELECT id AS src, nxt AS dst FROM n WHERE nxt IS NOT NULL UNION ALL SELECT nxt, id FROM n WHERE nxt IS NOT NULL)"""
_SHARED = r"""
x AS (
  SELECT DISTINCT id, entity FROM (
    SELECT id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(e, '^"+', ''), '"+$', ''), '(?i)^(?:the|a|an)[\s\p{Z}]+', '')), '[^a-z0-9 ]+', '', 'g')) AS entity
    FROM (SELECT id, unnest(regexp_extract_all(regexp_replace(text, '[^\P{L}A-Za-z]|[^\P{N}0-9]', '_', 'g'),
      '[A-Z][a-z]+(?:[\s\p{Z}]+[A-Z][a-z]+)+|"[^"]{3,60}"|\b[A-Z]{2,8}\b')) AS e FROM c WHERE text IS NOT NULL)) WHERE length(entity) >= 3),
y AS (SELECT * FROM x WHERE entity IN (SELECT entity FROM x GROUP BY entity HAVING count(*) BETWEEN 2 AND 50)),
h AS (SELECT a.id AS a, b.id AS b, count(*) AS weight FROM y a JOIN y b ON a.entity = b.entity AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2),
he AS (SELECT a AS src, b AS dst, weight FROM h UNION ALL SELECT b, a, weight FROM h)"""
_VARIANTS = r"""
sv AS (
  SELECT variant, min(source_name) AS source_name FROM (
    SELECT source_name, unnest([lower(source_name), lower(st), trim(regexp_replace(lower(source_name), '[^a-z0-9 ]+', '', 'g')), trim(regexp_replace(lower(st), '[^a-z0-9 ]+', '', 'g')), lower(split_part(site_host, '.', 1))]) AS variant
    FROM (SELECT source_name, site_host, regexp_replace(source_name, '(.)\.[^.]+$', '\1') AS st FROM doc_sources WHERE source_name IS NOT NULL)) WHERE length(variant) >= 4 GROUP BY variant)"""
_NAMED = _VARIANTS + """,
ce AS (SELECT DISTINCT id, sv.source_name AS names_source FROM c JOIN sv ON contains(lower(text), variant) WHERE c.source_name IS DISTINCT FROM sv.source_name)"""
_ALL = f"""{_C} {_PARENT}, {_SAME}, {_SHARED}, {_NAMED},
u AS (SELECT src, dst, 1 AS o, 'parent_of' AS relation, NULL::BIGINT AS weight FROM pe UNION ALL SELECT src, dst, 2, 'same_source', NULL FROM se UNION ALL SELECT src, dst, 3, 'shared_entities', weight FROM he),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o) AS n FROM u) WHERE n = 1),
e AS (
  SELECT src, dst, CASE WHEN ce.id IS NOT NULL THEN 'cross_reference' ELSE relation END AS relation, CASE WHEN ce.id IS NULL THEN coalesce(weight, 0) ELSE 0 END AS weight
  FROM b LEFT JOIN c ON c.id = b.dst LEFT JOIN ce ON ce.id = b.src AND ce.names_source = c.source_name
  UNION ALL SELECT id, 'source:' || names_source, 'cross_reference', 0 FROM ce)"""
_CONNECTED = f"""{_ALL},
m AS (SELECT src, dst FROM e UNION SELECT 'source:' || source_name, id FROM c WHERE source_name IN (SELECT names_source FROM ce)),
a AS (SELECT src, dst FROM m UNION SELECT dst, src FROM m),
nn AS (SELECT id FROM c UNION SELECT src FROM a WHERE NOT starts_with(src, 'source:')),
r AS (SELECT id, id AS component FROM nn UNION SELECT a.dst, r.component FROM r JOIN a ON a.src = r.id),
f AS (SELECT id, min(component) AS component FROM r GROUP BY id HAVING NOT starts_with(id, 'source:'))"""
SQL = {
    "edges_parent": f"{_C} {_PARENT} SELECT * FROM pe",
    "edges_same_source": f"{_C} {_SAME} SELECT * FROM se",
    "edges_shared": f"{_C} {_SHARED} SELECT * FROM he",
    "edges_cross_ref": f"{_C} {_NAMED} SELECT * FROM ce",
    "pages_cross_ref": f"""WITH {_VARIANTS}
SELECT DISTINCT raw_id::VARCHAR AS id, sv.source_name AS names_source FROM raw_documents d JOIN sv ON contains(lower(text), variant) WHERE d.source_name IS DISTINCT FROM sv.source_name""",
    "edges_all": f"{_ALL} SELECT * FROM e",
    "bfs_2hop": f"""{_ALL},
ways AS (SELECT src, dst FROM e WHERE NOT starts_with(dst, 'source:') UNION SELECT ce.id, c.id FROM ce JOIN c ON c.source_name = ce.names_source),
r AS (SELECT id, 0 AS dist FROM c WHERE pos % 100 = 0 UNION SELECT w.dst, r.dist + 1 FROM r JOIN ways w ON w.src = r.id WHERE r.dist < 2)
SELECT id, min(dist)::INT AS dist FROM r GROUP BY id HAVING min(dist) > 0""",
    "graph_stats": f"""{_CONNECTED}
SELECT relation, count(*) AS n FROM e GROUP BY relation UNION ALL SELECT 'edges', count(*) FROM e
UNION ALL SELECT 'nodes', count(*) FROM f UNION ALL SELECT 'components', count(DISTINCT component) FROM f""",
    "graph_components": f"{_CONNECTED} SELECT id, component FROM f",
}
