"""Retrieval: a written text index with BM25, exact dense top-k in blocks, fusion and expansion.

Every operator takes a table of queries, so many are answered in one job. The index is written once (:func:`write_index`) and read by every
search: one row a text with its tokens and their counts, the tokens' weights, and the table's figures. A search reads it where it lies: each task scores
its texts against a block of queries, which is broadcast behind a check of its size, and passes on the best ``k`` of each query, so
what is shuffled is k rows a query and task, however frequent a token is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import tokens
from lorespark.operators.graph import SOURCE
from lorespark.operators.skew import SMALL, small_side, spread
from lorespark.plans.durable import durable

K1, B, EPSILON = 1.5, 0.75, 0.25
DENSE, SPARSE, LEAST_SCORE = 0.7, 0.3, 0.1
QUERIES_A_BLOCK = 500
SCORES_AT_ONCE = 4_000_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id, tf)."""
    words = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    return words.groupBy("token", "id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl): tokens of each text; a text without one has 0."""
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("dl"))


def token_weights(posts: DataFrame, n_docs: int) -> DataFrame:
    """(token, idf); a token of more than half the texts gets EPSILON of the mean."""
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    raw = df.select("token", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, id, score) of every text that shares a token with the query; a token counts as often as the query has it.

    Only postings of query tokens are joined; a frequent token's postings meet the queries by broadcast if those are few, so that its key is not one task's.
    """
    # a 64-bit key of the id, where ids are strings: what is summed many times is kept narrow
    keyed = spread(docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))).withColumn("key", F.xxhash64("name"))
    posts, dl = postings(keyed, "key", "text"), lengths(keyed, "key", "text")
    n, mean = dl.agg(F.count("*"), F.avg("dl")).first()
    asked = durable(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf")))
    # the part of a posting that no query changes comes first, so what meets the queries is ready to be summed where it is
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    impacts = posts.join(dl, "id").select("token", "id", part.alias("part"))
    wanted = asked.join(token_weights(posts, n), "token").select("token", "query_id", (F.col("qtf") * F.col("idf")).alias("weight"))
    met = impacts.join(F.broadcast(wanted) if asked.count() <= SMALL else wanted, "token")
    scores = met.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
    return scores.withColumnRenamed("id", "key").join(keyed.select("key", F.col("name").alias("id")), "key").select("query_id", "id", "score")


def write_index(docs: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """The index of ``docs`` below ``folder``, anew: ``texts`` (id, dl, terms, counts), ``weights`` (term, idf) and ``figures`` (n, mean).

    A term is the 64-bit hash of a token. A text without a token has none; rows without an id are left out.
    """
    given = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words")))
    hashed = given.select("id", F.size("words").alias("dl"), F.transform("words", lambda w: F.xxhash64(w)).alias("terms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("terms")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            term = column.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((term, owner))
            owner, term = owner[order], term[order]
            new = np.ones(len(term), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
            first = np.nonzero(new)[0]
            counts = np.diff(np.append(first, len(term))).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (term[first], counts)]
            yield pa.record_batch([batch.column("id"), batch.column("dl"), *lists], names=["id", "dl", "terms", "counts"])

    kind = hashed.schema["id"].dataType.simpleString()
    hashed.mapInArrow(count, f"id {kind}, dl INT, terms ARRAY<BIGINT>, counts ARRAY<INT>").write.mode("overwrite").parquet(f"{folder}/texts")
    texts = docs.sparkSession.read.parquet(f"{folder}/texts")
    texts.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).write.mode("overwrite").parquet(f"{folder}/figures")
    n = docs.sparkSession.read.parquet(f"{folder}/figures").first()["n"]
    token_weights(texts.select("id", F.explode("terms").alias("token")), n).withColumnRenamed("token", "term").write.mode("overwrite").parquet(f"{folder}/weights")


def _asked(queries: DataFrame, folder: str) -> DataFrame:
    """(query_id, term, weight): idf times how often the query has the token."""
    words = queries.select("query_id", F.explode(tokens(F.coalesce("query", F.lit("")))).alias("w")).select("query_id", F.xxhash64("w").alias("term"))
    counted = words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = queries.sparkSession.read.parquet(f"{folder}/weights")
    return counted.join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def bm25_top(queries: DataFrame, folder: str, k: int) -> DataFrame:
    """(query_id, id, score): each query's best ``k`` texts of a written index that share a token with it, and ties of the last place in a task.

    Queries are answered in blocks of QUERIES_A_BLOCK, a reading of the index each.
    """
    spark = queries.sparkSession
    mean = spark.read.parquet(f"{folder}/figures").first()["mean"]
    asked = durable(_asked(queries, folder))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES_A_BLOCK))
    texts = spark.read.parquet(f"{folder}/texts")
    kinds = [asked.schema["query_id"].dataType, texts.schema["id"].dataType]
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # the tokens of about QUERIES_A_BLOCK queries
        names = rows["query_id"].combine_chunks().dictionary_encode() if rows.num_rows else None
        term = rows["term"].to_numpy()
        order = np.argsort(term, kind="stable")
        wanted, first = np.unique(term[order], return_index=True)
        ask = (wanted, np.append(first, len(term)), names.indices.to_numpy()[order] if names else None, rows["weight"].to_numpy()[order], names.dictionary if names else None)
        shared = spark.sparkContext.broadcast(ask)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, offset, query, weight, names = shared.value
            if not len(wanted):
                return
            for whole in batches:
                step = max(1, SCORES_AT_ONCE // len(names))
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    terms, counts = batch.column("terms"), batch.column("counts")
                    doc = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
                    term, tf = terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
                    slot = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
                    hit = wanted[slot] == term
                    doc, tf, slot = doc[hit], tf[hit], slot[hit]
                    dl = batch.column("dl").to_numpy()[doc]
                    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                    n = offset[slot + 1] - offset[slot]
                    if not n.sum():
                        continue
                    entry = np.repeat(offset[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    cell = query[entry].astype(np.int64) * batch.num_rows + np.repeat(doc, n)
                    size = len(names) * batch.num_rows
                    scores = np.bincount(cell, weights=weight[entry] * np.repeat(part, n), minlength=size).reshape(len(names), -1)
                    met = np.zeros(size, bool)
                    met[cell] = True
                    scores = np.where(met.reshape(scores.shape), np.round(scores, 9), -np.inf)
                    most = min(k, batch.num_rows)
                    least = np.partition(scores, batch.num_rows - most, axis=1)[:, batch.num_rows - most]
                    q, d = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                    yield pa.record_batch([names.take(pa.array(q)), batch.column("id").take(pa.array(d)), pa.array(scores[q, d])], names=["query_id", "id", "score"])

        found = texts.mapInArrow(run, f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score DOUBLE")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def bm25_of(pairs: DataFrame, queries: DataFrame, folder: str) -> DataFrame:
    """(query_id, id, score) of given pairs that share a token."""
    spark = queries.sparkSession
    mean = spark.read.parquet(f"{folder}/figures").first()["mean"]
    texts = spark.read.parquet(f"{folder}/texts").join(small_side(pairs.select("id").distinct()), "id", "left_semi")
    held = pairs.select("query_id", "id").join(texts, "id").select("query_id", "id", "dl", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    met = held.select("query_id", "id", "dl", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf")).join(_asked(queries, folder), ["query_id", "term"])
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return met.groupBy("query_id", "id").agg(F.sum(F.col("weight") * part).alias("score"))


def over_best(scores: DataFrame, best: DataFrame) -> DataFrame:
    """Scores over the highest of each query in ``best``, where that is positive."""
    top = best.groupBy("query_id").agg(F.max("score").alias("top"))
    return scores.join(top, "query_id").select("query_id", "id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores over each query's highest, where that is positive."""
    top = scores.groupBy("query_id").agg(F.max("score").alias("top"))
    return scores.join(top, "query_id").select("query_id", "id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query by score to six decimals, then id, with their rank from 1; the limit is applied before the shuffle. With
    ``k`` -1 all are ranked."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scores.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w))
    return ranked if k == -1 else ranked.where(F.col("rank") <= k)


def clamped(k: int, most: int = 20) -> int:
    """A number of results that a caller may ask for: 1 to ``most``, or -1 for all."""
    return k if k == -1 else max(1, min(k, most))


def dense_scores(queries: DataFrame, docs: DataFrame, id_col: str, vector_col: str, dim: int, k: int) -> DataFrame:
    """(query_id, id, score): each query's best ``k`` by cosine among the usable vectors, six decimals, then id.

    Each task multiplies its vectors with a broadcast block of QUERIES_A_BLOCK queries and passes on k rows a query, so what is shuffled is k
    rows a query and batch; every further block is another reading of the vectors. Null, wrong-length, zero and non-finite vectors match nothing.
    """
    usable = lambda c: (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    asked = durable(queries.where(usable(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("vector")))
    blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))
    own = spread(docs.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")))
    kinds = [queries.schema["query_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]

    def unit(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        return flat / np.linalg.norm(flat, axis=1, keepdims=True)

    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # about QUERIES_A_BLOCK vectors
        empty = pa.array([], pa.list_(pa.float64()))
        shared = docs.sparkSession.sparkContext.broadcast((part["query_id"].combine_chunks(), unit(part["vector"].combine_chunks() if part.num_rows else empty)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked_for = shared.value
            for batch in batches:
                if not len(names) or not batch.num_rows:
                    continue
                cos = np.round(asked_for @ unit(batch.column("v")).T, 6)
                most = min(k, cos.shape[1])
                least = np.partition(cos, cos.shape[1] - most, axis=1)[:, cos.shape[1] - most]
                a, b = np.nonzero(cos >= least[:, None])  # ties of the last place too
                yield pa.record_batch([names.take(pa.array(a)), batch.column("id").take(pa.array(b)), pa.array(cos[a, b])], names=["query_id", "id", "score"])

        found = own.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score DOUBLE")
        out = found if out is None else out.unionByName(found)
    return top_k(out, k).drop("rank")


def fused(dense: DataFrame, sparse: DataFrame, all_sparse: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Candidates of either arm, DENSE and SPARSE weighted. A missing sparse score is looked up in ``all_sparse``, a missing dense one is 0."""
    d, s, every = dense.withColumnRenamed("score", "d"), sparse.withColumnRenamed("score", "s"), all_sparse.withColumnRenamed("score", "e")
    both = d.join(s, ["query_id", "id"], "full_outer").join(every, ["query_id", "id"], "left")
    score = DENSE * F.coalesce("d", F.lit(0.0)) + SPARSE * F.coalesce("s", "e", F.lit(0.0))
    return both.select("query_id", "id", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def hybrid(queries: DataFrame, docs: DataFrame, id_col: str, vector_col: str, dim: int, folder: str, k: int = 5, wide: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): queries with query_id, query and vector, against ``docs`` and the index that was written of the same rows.

    Filters belong in ``docs`` before its index is written, so both arms see them. ``wide`` candidates an arm, 5 k unless given.
    """
    return fused_top(queries, dense_scores(queries, docs, id_col, vector_col, dim, wide or 5 * k), folder, k, wide or 5 * k)


def fused_top(queries: DataFrame, dense: DataFrame, folder: str, k: int, wide: int) -> DataFrame:
    """The best ``k`` of dense candidates and the index's ``wide`` best of each query."""
    dense, best = durable(dense), durable(bm25_top(queries, folder, wide))
    sparse = over_best(best, best).where("score > 0")
    back = over_best(bm25_of(dense.join(best, ["query_id", "id"], "left_anti"), queries, folder), best)
    return top_k(fused(dense, top_k(sparse, wide).drop("rank"), back), k)


def expanded(ranked: DataFrame, edges: DataFrame, belongs: DataFrame, most: int = 3, hops: int = 2) -> DataFrame:
    """``ranked`` and, behind it, up to ``most`` chunks a query that the graph relates to its results and that aren't among them, by distance and id, score 0.

    Walks start from the results of all queries at once; a chunk counts for the queries whose results it is near to.
    """
    front = ranked.select("query_id", "id").withColumn("dist", F.lit(0))
    reached = front
    for hop in range(1, hops + 1):
        step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).join(front.select("query_id", "id"), "id").select("query_id", F.col("next").alias("id")).distinct()
        source = step.where(F.col("id").startswith(SOURCE))
        inside = belongs.select(F.col("src").alias("id"), F.col("dst").alias("next")).join(source, "id").select("query_id", F.col("next").alias("id"))
        step = step.where(~F.col("id").startswith(SOURCE)).union(inside).distinct()
        front = durable(step.join(reached.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("dist", F.lit(hop)))
        reached = reached.unionByName(front)
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    near = reached.where("dist > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    last = ranked.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = near.join(last, "query_id").select("query_id", "id", F.lit(0.0).alias("score"), (F.col("last") + F.col("n")).cast("int").alias("rank"))
    return ranked.select("query_id", "id", "score", "rank").unionByName(more)


def max_fusion(scores: DataFrame) -> DataFrame:
    """One score a main query and text: the best of its parts. ``scores`` has query_id, part, id, score."""
    return scores.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def parents_for_children(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): a child gives way to its parent, at the place of the parent's first child, with the best child's score.

    ``chunks`` has id, chunk_type, parent_id. Where the parent is missing, its first child stays.
    """
    known = ranked.join(chunks.select("id", "chunk_type", "parent_id"), "id")
    child = (F.col("chunk_type") == "child") & F.col("parent_id").isNotNull()
    placed = known.withColumn("family", F.when(child, F.col("parent_id")).otherwise(F.col("id"))).withColumn("is_child", F.coalesce(child, F.lit(False)))
    grouped = placed.groupBy("query_id", "family", "is_child").agg(F.min(F.struct("rank", "id", "score")).alias("first"), F.max("score").alias("best"))
    there = chunks.select(F.col("id").alias("family")).distinct().withColumn("there", F.lit(True))
    out = grouped.join(there, "family", "left")
    parent = F.col("is_child") & F.col("there").isNotNull()
    out = out.select("query_id", F.when(parent, F.col("family")).otherwise(F.col("first.id")).alias("id"), F.when(parent, F.col("best")).otherwise(F.col("first.score")).alias("score"), F.col("first.rank").alias("place"), "is_child")
    w = Window.partitionBy("query_id").orderBy("place", "id", "is_child")
    return out.select("query_id", "id", "score", F.row_number().over(w).alias("rank"))


def embedded(docs: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], list[list[float]]], texts_at_once: int = 256) -> DataFrame:
    """(id, vector) by a model of the caller: a list of texts in, a vector each out. It is called in the tasks, so it must be picklable or open
    what it needs there. Null texts have no vector."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, texts_at_once):
                batch = whole.slice(at, texts_at_once)
                vectors = model(batch.column("text").to_pylist())
                yield pa.record_batch([batch.column("id"), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "vector"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"id {kind}, vector ARRAY<FLOAT>")


def reranked(ranked: DataFrame, queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, scorer: Callable[[list[str], list[str]], list[float]], chars: int = 1500) -> DataFrame:
    """The ``k`` best of each query by a pair model of the caller: queries and texts (their first ``chars`` characters) in, a score each out."""
    q = queries.select("query_id", F.substring(F.coalesce("query", F.lit("")), 1, chars).alias("q"))
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pairs = ranked.select("query_id", "id").join(q, "query_id").join(t, "id").select("query_id", "id", "q", "t")
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("query_id", "id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column("q").to_pylist(), batch.column("t").to_pylist())
            yield pa.record_batch([batch.column("query_id"), batch.column("id"), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    return top_k(pairs.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score DOUBLE"), k)


def overlap_rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The default scorer in place of a pair model: the share of the query's distinct tokens that the text has."""
    q = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("q"))
    t = docs.select(F.col(id_col).alias("id"), F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    share = F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1))
    return top_k(ranked.select("query_id", "id").join(q, "query_id").join(t, "id").select("query_id", "id", share.alias("score")), k)


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(id, vector): unit vectors of token counts by hash slot, in the JVM; the default embedding where no model is given."""
    slots = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    counted = slots.select("id", F.pmod(F.xxhash64("token"), F.lit(dim)).cast("int").alias("slot")).groupBy("id", "slot").agg(F.count("*").alias("n"))
    row = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return row.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.col("m")[i], F.lit(0)) / F.col("norm")).cast("float")).alias("vector"))


def metadata_filter(filters: dict[str, object]) -> Column:
    """All equalities of ``filters``; none of them lets everything through."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & (F.col(name) == value)
    return out


def context_blocks(ranked: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, context): the texts of a query in rank order, each behind '[Context n]'. ``ranked`` holds a few rows a query."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    block = F.concat(F.lit("[Context "), F.col("rank").cast("string"), F.lit("]\n"), F.col("text"))
    blocks = ranked.join(text, "id").where("text IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


