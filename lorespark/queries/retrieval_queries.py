"""Search over the knowledge chunks. The queries are the chunks whose position is divisible by 100, against all chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import EXPANSIONS, decompose_query, expand_query
from lorespark.operators import graph as G
from lorespark.operators import search as S
from lorespark.operators.skew import first_rows
from lorespark.plans.durable import durable, shared_dir
from lorespark.sources.tables import table

DIM = 96


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first arrival of every chunk id that has a text."""
    return first_rows(table(spark, d, "knowledge_chunks").where("text IS NOT NULL"), "id", ["batch_no", "pos"])


def _queries(chunks: DataFrame) -> DataFrame:
    return chunks.where("pos % 100 = 0").select(F.col("pos").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("vector"))


def _indexed(chunks: DataFrame) -> str:
    """The folder of a new index of the chunks."""
    folder = f"{shared_dir(chunks.sparkSession).rstrip('/')}/index-{uuid.uuid4().hex}"
    S.write_index(chunks, "id", "text", folder)
    return folder


def _ranked(spark: SparkSession, d: str, k: int, wide: int = 25) -> tuple[DataFrame, DataFrame]:
    """(chunks, the ``k`` best of each query over both arms)."""
    chunks = _chunks(spark, d)
    return chunks, durable(S.hybrid(_queries(chunks), chunks, "id", "embedding", DIM, _indexed(chunks), k, wide))


def bm25_topk(spark, d):
    chunks = _chunks(spark, d)
    best = durable(S.bm25_top(_queries(chunks), _indexed(chunks), 6))
    return S.top_k(S.over_best(best, best), 5)


def dense_topk(spark, d):
    chunks = _chunks(spark, d)
    return S.top_k(S.dense_scores(_queries(chunks), chunks, "id", "embedding", DIM, 5), 5)


def hybrid_topk(spark, d):
    return _ranked(spark, d, 5)[1]


def filtered_topk(spark, d):
    """Only flat web chunks are searched, in both arms."""
    chunks = _chunks(spark, d)
    some = chunks.where(S.metadata_filter({"source_type": "web_doc"})).where("chunk_type IS NULL")
    return S.hybrid(_queries(chunks), some, "id", "embedding", DIM, _indexed(some))


def multi_query_topk(spark, d):
    """Each query is cut into its longest parts, each part expanded and scored; the best part counts, beside the query's vector."""
    chunks = _chunks(spark, d)
    queries, folder = _queries(chunks), _indexed(chunks)
    parts = queries.select("query_id", F.posexplode(decompose_query(F.col("query"))).alias("part", "query"))
    asked = durable(parts.select(F.concat_ws("/", "query_id", "part").alias("query_id"), expand_query(F.col("query")).alias("query")))
    main = F.substring_index("query_id", "/", 1).cast("bigint").alias("query_id")
    best = durable(S.bm25_top(asked, folder, 26))
    sparse = S.max_fusion(S.over_best(best, best).select(main, "id", "score"))
    dense = durable(S.dense_scores(queries, chunks, "id", "embedding", DIM, 25))
    # scores of the dense candidates for every part of their query
    of_parts = asked.select("query_id", main.alias("main")).join(dense.select(F.col("query_id").alias("main"), "id"), "main").select("query_id", "id")
    back = S.max_fusion(S.over_best(S.bm25_of(of_parts, asked, folder), best).select(main, "id", "score"))
    # the best 25 of the fused parts; what only a part's 26 best hold is looked up for all parts
    wide = S.top_k(sparse.where("score > 0"), 25).drop("rank")
    return S.top_k(S.fused(dense, wide, back), 5)


def parent_expand(spark, d):
    chunks, ranked = _ranked(spark, d, 10, 50)
    return S.parents_for_children(ranked, chunks)


def reranked(spark, d):
    """Three times as many candidates as asked for, then the pair scorer."""
    chunks, wide = _ranked(spark, d, 15)
    return S.overlap_rerank(wide, _queries(chunks), chunks, "id", "text", 5)


def context_blocks(spark, d):
    chunks, ranked = _ranked(spark, d, 3)
    return S.context_blocks(ranked, chunks, "id", "text")


def graph_expand(spark, d):
    """Results and up to three related chunks each, over all relations."""
    chunks, ranked = _ranked(spark, d, 5)
    chunks = durable(chunks.withColumn("place", F.col("pos")))
    names = table(spark, d, "doc_sources", "source_name", "site_host").select("source_name", F.substring_index("site_host", ".", 1).alias("alias"))
    return S.expanded(ranked, durable(G.all_edges(chunks, names)), G.members(chunks))


def hashed_embedding(spark, d):
    return S.hashed_vectors(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def token_idf(spark, d):
    chunks = _chunks(spark, d)
    weights = S.token_weights(S.postings(chunks, "id", "text"), chunks.count())
    return weights.select("token", F.round("idf", 6).alias("idf"))


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, dense_topk, hybrid_topk, filtered_topk, multi_query_topk, parent_expand, reranked, context_blocks, graph_expand, hashed_embedding, token_idf)
}

_CHUNKS = """
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no, pos) AS arrival FROM knowledge_chunks WHERE text IS NOT NULL AND id IS NOT NULL) WHERE arrival = 1),
"""
_Q = "q AS (SELECT pos AS query_id, text AS query, embedding AS vector FROM c WHERE pos % 100 = 0),"
_BM25 = r"""
t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM {docs}),
p AS (SELECT token, id, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS dl FROM {docs}),
s AS (SELECT count(*) AS n, avg(dl) AS mean FROM l),
r AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY token, n),
w AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
a AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS token FROM q) GROUP BY ALL),
b AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM a JOIN w USING (token) JOIN p USING (token) JOIN l USING (id), s GROUP BY ALL),
z AS (SELECT query_id, id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE score END AS score FROM b),
"""
_RANKED = "SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS rank FROM {}) WHERE rank <= {}"
_USABLE = "len({0}) = 96 AND list_bool_and(list_transform({0}, lambda y: isfinite(y))) AND list_bool_or(list_transform({0}, lambda y: y <> 0))"


def _dense(docs: str, k: int) -> str:
    return f"""
vq AS (SELECT query_id, vector::DOUBLE[96] AS e FROM q WHERE {_USABLE.format("vector")}),
vd AS (SELECT id, embedding::DOUBLE[96] AS e FROM {docs} WHERE {_USABLE.format("embedding")}),
dd AS (SELECT query_id, id, round(array_cosine_similarity(vq.e, vd.e), 6) AS score FROM vq, vd),
dk AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM dd) WHERE n <= {k}),
"""


def _hybrid(docs: str, k: int = 5, wide: int = 25) -> str:
    """CTEs up to hg, the ranked results."""
    return (
        _BM25.replace("{docs}", docs) + _dense(docs, wide)
        + """
sk AS (SELECT query_id, id, score FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS n FROM z WHERE score > 0) WHERE n <= WIDE),
f AS (
  SELECT query_id, id, round(0.7 * coalesce(dk.score, 0) + 0.3 * coalesce(sk.score, z.score, 0), 6) AS score
  FROM dk FULL JOIN sk USING (query_id, id) LEFT JOIN z USING (query_id, id)),
fg AS (SELECT * FROM f WHERE score >= 0.1),
g AS (""".replace("WIDE", str(wide)) + _RANKED.format("fg", k) + ")"
    )


def _sparse(k: int) -> str:
    return _BM25.replace("{docs}", "c") + f"g AS ({_RANKED.format('z', k)})"


_PARTS = r"""
ps AS (
  SELECT pos AS main, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '\n(#{1,4}\s)', chr(1) || '\1', 'g'),
    '(\d+\.\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')), lambda x: length(x) > 30) AS parts FROM c WHERE pos % 100 = 0),
pr AS (
  SELECT main, unnest(CASE WHEN length(text) < 300 OR len(parts) <= 1 THEN [text]
    ELSE list_transform(list_sort(list_transform(parts, lambda x, i: {'a': -length(x), 'b': i, 'c': x}))[1:4], lambda x: x.c) END) AS part FROM ps),
pw AS (SELECT main, row_number() OVER () AS n, part, list_transform(list_filter([PAIRS], lambda p: contains(lower(part), p.term) AND NOT contains(lower(part), p.word)), lambda p: p.word) AS more FROM pr),
q AS (SELECT {'m': main, 'n': n} AS query_id, CASE WHEN len(more) > 0 THEN part || chr(10) || chr(10) || 'Related terms: ' || array_to_string(more[1:15], ' ') ELSE part END AS query FROM pw),
""".replace("PAIRS", ", ".join(f"{{'term': '{t}', 'word': '{w}'}}" for t, ws in EXPANSIONS.items() for w in ws))
SQL = {
    "multi_query_topk": "WITH " + _CHUNKS + _PARTS + _BM25.replace("{docs}", "c") + _dense("c", 25).replace("FROM q WHERE", "FROM (SELECT pos AS query_id, embedding AS vector FROM c WHERE pos % 100 = 0) WHERE") + """
mf AS (SELECT query_id.m AS query_id, id, max(score) AS score FROM z GROUP BY ALL),
sk AS (SELECT query_id, id, score FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS n FROM mf WHERE score > 0) WHERE n <= 25),
f AS (
  SELECT query_id, id, round(0.7 * coalesce(dk.score, 0) + 0.3 * coalesce(sk.score, mf.score, 0), 6) AS score
  FROM dk FULL JOIN sk USING (query_id, id) LEFT JOIN mf USING (query_id, id)),
fg AS (SELECT * FROM f WHERE score >= 0.1)
""" + _RANKED.format("fg", 5),
    "bm25_topk": "WITH " + _CHUNKS + _Q + _sparse(5) + " SELECT * FROM g",
    "dense_topk": "WITH " + _CHUNKS + _Q + _dense("c", 5) + "g AS (SELECT 1) " + _RANKED.format("dk", 5),
    "hybrid_topk": "WITH " + _CHUNKS + _Q + _hybrid("c") + " SELECT * FROM g",
    "filtered_topk": "WITH " + _CHUNKS + _Q + "cf AS (SELECT * FROM c WHERE source_type = 'web_doc' AND chunk_type IS NULL)," + _hybrid("cf") + " SELECT * FROM g",
    "parent_expand": "WITH " + _CHUNKS + _Q + _hybrid("c", 10, 50) + """,
k AS (SELECT g.*, coalesce(chunk_type = 'child' AND parent_id IS NOT NULL, false) AS is_child, parent_id FROM g JOIN c USING (id)),
m AS (
  SELECT query_id, CASE WHEN is_child THEN parent_id ELSE id END AS family, is_child, min({'r': rank, 'i': id, 's': score}) AS first, max(score) AS best FROM k GROUP BY ALL),
o AS (
  SELECT query_id, CASE WHEN is_child AND family IN (SELECT id FROM c) THEN family ELSE first.i END AS id,
    CASE WHEN is_child AND family IN (SELECT id FROM c) THEN best ELSE first.s END AS score, first.r AS place, is_child FROM m)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY place, id, is_child)::INT AS rank FROM o""",
    "reranked": "WITH " + _CHUNKS + _Q + _hybrid("c", 15) + r""",
o AS (
  SELECT query_id, g.id, len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')), list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))))::DOUBLE
    / greatest(len(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'))), 1) AS score FROM g JOIN q USING (query_id) JOIN c ON c.id = g.id)
""" + _RANKED.format("o", 5),
    "context_blocks": "WITH " + _CHUNKS + _Q + _hybrid("c", 3) + """
SELECT query_id, string_agg('[Context ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM g JOIN c USING (id) GROUP BY query_id""",
    "token_idf": "WITH " + _CHUNKS + _Q + _BM25.replace("{docs}", "c").rstrip().rstrip(",") + " SELECT token, round(idf, 6) AS idf FROM w",
}
