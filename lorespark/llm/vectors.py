"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds, reranked exactly.

A vector o of unit length is rotated at random and kept as the signs of its coordinates, packed to bits, with one correction scalar
f = <sign vector / sqrt(D), o>. For a query q (rotated, eight bits a coordinate) the estimate of <o, q> is
<sign vector / sqrt(D), q> / f; its error is a fraction sqrt(1 - <o, q>^2) of a normal deviate with standard deviation
sqrt((1 - f^2) / (f^2 (D - 1))). Pairs whose bound reaches the floor, and the k-th best estimate, are reranked with the whole vectors.

Routing keeps the work below all pairs: ``lists`` centroids (fitted on at most SAMPLES_A_LIST vectors a list, chosen by a hash of the id) cut the
sphere into lists; every code is filed under its ``spread`` nearest centroids, a query visits its nearest one. A list that is larger
than a block is cut into blocks by a hash, codes and queries alike, so no group outgrows a task. Every vector is filed, none is
capped: a query for which codes cannot tell a crowd of neighbours apart is compared with the whole vectors of the block, which
pass on only its ``k`` best. Groups of exact copies are one vector in the index; copies are each other's nearest without being compared.

Defined results: null, wrong-length, all-zero and non-finite vectors are left out; an id that comes again counts once, at its first
position; ties of the similarity (six decimals) go to the smaller position; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.skew import attach_by_key
from lorespark.plans.durable import durable

SAMPLES_A_LIST, LEAST_SAMPLE, MOST_SAMPLE = 4, 20_000, 262_144  # vectors to fit on: 100 MB at most
CODES_A_BLOCK, QUERIES_A_BLOCK = 40_000, 8_000
ROWS_A_TASK = 25_000  # codes and queries of one task of the comparison, some 3 MB, unless one block has more
#: A query that a block answers with more candidates than this (with a floor, without one) is compared with the whole vectors there.
CROWD = (64, 2_000)


def usable_vectors(df: DataFrame, id_col: str, pos_cols: list[str], vector_col: str, dim: int) -> DataFrame:
    """(id, pos, copy_key, embedding) of the vectors that can be compared."""
    v = F.col(vector_col)
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & ok).select(
        F.col(id_col).alias("id"), F.struct(*pos_cols).alias("pos"), F.struct(F.xxhash64(v), F.xxhash64(F.lit(1), v)).alias("copy_key"), v.alias("embedding")
    )


class Rotation:
    """What every task needs to encode: the rotation and the centroids, a few hundred kilobytes."""

    def __init__(self, dim: int, lists: int, sample: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.matrix = np.linalg.qr(rng.normal(size=(dim, dim)))[0].astype(np.float32)
        self.centroids = self._fit(sample, max(1, min(lists, len(sample))), rng) if len(sample) else np.zeros((1, dim), np.float32)

    @staticmethod
    def _fit(sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
        centroids = sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(rounds if lists > 1 else 0):
            nearest = (sample @ centroids.T).argmax(1)
            order = np.argsort(nearest, kind="stable")
            starts = np.searchsorted(nearest[order], np.arange(lists))
            sums = np.add.reduceat(sample[order], np.minimum(starts, len(sample) - 1), axis=0)
            filled = np.bincount(nearest, minlength=lists) > 0
            lengths = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(filled[:, None] & (lengths > 1e-9), sums / np.maximum(lengths, 1e-9), centroids)
        return centroids.astype(np.float32)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def fit(nodes: DataFrame, dim: int, lists: int) -> Rotation:
    """The rotation and centroids, from a bounded number of vectors with the smallest hash of their id."""
    sample = min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLES_A_LIST * lists))
    # about twice as many are sorted, however many there are
    share = min(1.0, 2 * sample / max(1, nodes.count()))
    rows = nodes.select("embedding", F.xxhash64("vid").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h").limit(sample).select("embedding").toArrow()
    column = rows["embedding"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float32()))
    return Rotation(dim, lists, unit_rows(column, dim).astype(np.float32))


CODES = "list INT, vid BIGINT, code BINARY, f FLOAT"
ASKED = "list INT, vid BIGINT, query BINARY, scale FLOAT"


def encode(nodes: DataFrame, rotation: Rotation, dim: int, spread: int) -> DataFrame:
    """The codes (``CODES``), filed under the ``spread`` nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(batch.column("embedding"), dim).astype(np.float32)
            n = min(spread, len(rotation.centroids))
            sims = unit @ rotation.centroids.T
            near = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.tile(np.arange(n), (len(unit), 1))
            turned = unit @ rotation.matrix
            bits = np.packbits(turned > 0, axis=1)
            f = np.abs(turned).sum(1) / np.sqrt(dim)
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            at = pa.array(np.repeat(np.arange(len(unit)), n))
            yield pa.record_batch(
                [pa.array(near.ravel().astype(np.int32)), batch.column("vid").take(at), packed.take(at), pa.array(np.repeat(f, n).astype(np.float32))],
                names=["list", "vid", "code", "f"],
            )

    return nodes.select("vid", "embedding").mapInArrow(run, CODES)


def ask(nodes: DataFrame, rotation: Rotation, dim: int) -> DataFrame:
    """The queries (``ASKED``): rotated, eight bits a coordinate, at their nearest list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(batch.column("embedding"), dim).astype(np.float32)
            turned = unit @ rotation.matrix
            scale = np.abs(turned).max(1) / 127
            levels = np.rint(turned / scale[:, None]).astype(np.int8)
            own = (unit @ rotation.centroids.T).argmax(1).astype(np.int32)
            packed = pa.array([b.tobytes() for b in levels], pa.binary())
            yield pa.record_batch([pa.array(own), batch.column("vid"), packed, pa.array(scale.astype(np.float32))], names=["list", "vid", "query", "scale"])

    return nodes.select("vid", "embedding").mapInArrow(run, ASKED)


def placed(nodes: DataFrame, rotation: Rotation, dim: int, spread: int) -> DataFrame:
    """(list, vid, embedding): the whole vectors under the lists that :func:`encode` files them under."""
    lists = encode(nodes, rotation, dim, spread).select("list", "vid")
    return lists.join(nodes.select("vid", "embedding"), "vid")


def _blocks(codes: DataFrame, asked: DataFrame) -> tuple[DataFrame, int]:
    """((list, code_cuts, query_cuts), tasks); one row a list, and the number of lists is a parameter, so this is small."""
    n_codes, n_asked = codes.groupBy("list").agg(F.count("*").alias("n")), asked.groupBy("list").agg(F.count("*").alias("m"))
    rows = [(r.list, -(-r.n // CODES_A_BLOCK), -(-r.m // QUERIES_A_BLOCK), r.n, r.m) for r in n_codes.join(n_asked, "list").collect()]
    met = sum(n * query_cuts + m * code_cuts for _, code_cuts, query_cuts, n, m in rows)
    cuts = codes.sparkSession.createDataFrame([r[:3] for r in rows], "list INT, code_cuts INT, query_cuts INT")
    return F.broadcast(cuts), max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // ROWS_A_TASK))


def _cogrouped(left: DataFrame, right: DataFrame, blocks: tuple[DataFrame, int], compare, schema: str) -> DataFrame:
    """Every block of codes with every block of queries of its list, in as many tasks as their rows need: a cogroup isn't split at run time."""
    cuts, tasks = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    rest = lambda df: [c for c in df.columns if c != "list"]
    left = left.join(cuts, "list").select("list", own("code_cuts").alias("cb"), every("query_cuts").alias("qb"), *rest(left))
    right = right.join(cuts, "list").select("list", every("code_cuts").alias("cb"), own("query_cuts").alias("qb"), *rest(right))
    keys = ["list", "cb", "qb"]
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


PAIRS = "q BIGINT, o BIGINT, est FLOAT, slack FLOAT"
_NO_PAIRS = pd.DataFrame({"q": [], "o": [], "est": [], "slack": []}).astype({"q": "int64", "o": "int64", "est": "float32", "slack": "float32"})


def candidates(nodes: DataFrame, askers: DataFrame, rotation: Rotation, dim: int, k: int, spread: int, floor: float, eps: float) -> DataFrame:
    """``PAIRS`` whose bound reaches ``floor`` and the k-th best estimate of the query."""
    codes, asked = encode(nodes, rotation, dim, spread), ask(askers, rotation, dim)
    crowd = CROWD[0] if floor > 0 else CROWD[1]

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return _NO_PAIRS
        bits = np.unpackbits(np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1), axis=1)[:, :dim]
        f = c["f"].to_numpy(np.float32)
        signs = (bits.astype(np.float32) * 2 - 1) / (f * np.sqrt(dim))[:, None]
        dev = eps * np.sqrt(np.maximum(1 - f * f, 0) / (f * f * (dim - 1)))
        turned = np.frombuffer(b"".join(q["query"]), np.int8).reshape(len(q), dim).astype(np.float32) * q["scale"].to_numpy(np.float32)[:, None]
        c_id, q_id, out = c["vid"].to_numpy(), q["vid"].to_numpy(), []
        tail = float(np.sqrt(1 - min(floor, 1.0) ** 2)) if floor > 0 else 1.0
        step = max(1, 8_000_000 // len(c))
        for s in range(0, len(q), step):
            est, ids = turned[s : s + step] @ signs.T, q_id[s : s + step]
            least = np.full(len(est), floor, np.float32)
            if floor <= 0 and len(c) > k + 1:  # one of the k + 1 best may be the query itself
                least = np.maximum(least, np.partition(est, len(c) - k - 1, axis=1)[:, len(c) - k - 1])
            met = est >= least[:, None] - dev * tail
            crowded = met.sum(1) > crowd
            met[crowded] = False
            a, b = np.nonzero(met)
            keep = ids[a] != c_id[b]
            a, b = a[keep], b[keep]
            out.append(pd.DataFrame({"q": ids[a], "o": c_id[b], "est": est[a, b], "slack": dev[b]}))
            out.append(pd.DataFrame({"q": ids[crowded], "o": ids[crowded], "est": np.float32(0), "slack": np.float32(0)}))  # marks, not pairs
        return pd.concat(out)

    met = durable(_cogrouped(codes, asked, _blocks(codes, asked), compare, PAIRS))
    pairs, marks = met.where("q <> o"), met.where("q = o").select(F.col("q").alias("vid")).distinct()
    if not marks.isEmpty():
        pairs = pairs.unionByName(_exact_in_lists(nodes, askers.join(marks, "vid", "left_semi"), rotation, dim, k, spread, floor))
    if floor > 0:
        return pairs
    # the k-th best over all blocks is sharper than that of one block
    w = Window.partitionBy("q").orderBy(F.desc("est"), "o")
    ranked = pairs.withColumn("rn", F.row_number().over(w))
    kth = F.max(F.when(F.col("rn") <= k, F.struct("rn", "est"))).over(Window.partitionBy("q"))["est"]
    return ranked.withColumn("kth", kth).where("est + slack >= kth").select("q", "o", "est", "slack")


def _exact_in_lists(nodes: DataFrame, askers: DataFrame, rotation: Rotation, dim: int, k: int, spread: int, floor: float) -> DataFrame:
    """``PAIRS`` of each asker with its ``k`` best of every block of its list, by the whole vectors."""
    at = placed(askers, rotation, dim, 1)
    lists = at.select("list").distinct()  # as many as there are lists at most
    stored = placed(nodes, rotation, dim, spread).join(F.broadcast(lists), "list", "left_semi")

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return _NO_PAIRS
        u, v = (np.stack(x["embedding"].to_numpy()).astype(np.float32) for x in (c, q))
        u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, v))
        c_id, q_id, out = c["vid"].to_numpy(), q["vid"].to_numpy(), []
        most, step = min(k + 1, len(c)), max(1, 8_000_000 // len(c))
        for s in range(0, len(q), step):
            cos, ids = v[s : s + step] @ u.T, q_id[s : s + step]
            b = np.argpartition(-cos, most - 1, axis=1)[:, :most]
            a = np.repeat(np.arange(len(cos)), most)
            b = b.ravel()
            keep = (ids[a] != c_id[b]) & (cos[a, b] >= floor - 1e-4)
            out.append(pd.DataFrame({"q": ids[a[keep]], "o": c_id[b[keep]], "est": cos[a[keep], b[keep]], "slack": np.float32(1e-5)}))
        return pd.concat(out)

    return _cogrouped(stored, at, _blocks(stored, at), compare, PAIRS)


def rerank(pairs: DataFrame, nodes: DataFrame, dim: int, floor: float) -> DataFrame:
    """(a, b, cos), a < b, once a pair, with the exact cosine to six decimals."""
    once = pairs.select(F.least("q", "o").alias("a"), F.greatest("q", "o").alias("b")).distinct()
    va = nodes.select(F.col("vid").alias("a"), F.col("embedding").alias("ea"))
    vb = nodes.select(F.col("vid").alias("b"), F.col("embedding").alias("eb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = (unit_rows(batch.column("ea"), dim) * unit_rows(batch.column("eb"), dim)).sum(1)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(np.round(cos, 6))], names=["a", "b", "cos"])

    return once.join(va, "a").join(vb, "b").mapInArrow(exact, "a BIGINT, b BIGINT, cos DOUBLE").where(F.col("cos") >= floor)


def nearest(
    vectors: DataFrame, dim: int, k: int = 5, lists: int = 256, spread: int = 8, floor: float = 0.0, eps: float = 3.5, asking: str | None = None
) -> DataFrame:
    """(id, other_id, cos, rank): the ``k`` most similar of every vector of :func:`usable_vectors`.

    ``floor`` > 0 restricts the result to pairs of at least that cosine. ``asking``, an SQL condition on ``id`` and ``pos``, restricts
    the queries; with ``lists=1`` they meet all rows, in blocks. ``spread`` of ``lists`` trades work for recall.
    """
    members = vectors.groupBy("copy_key", "id").agg(F.min("pos").alias("pos"))
    members = durable(members)
    nodes = vectors.groupBy("copy_key").agg(F.first("embedding").alias("embedding"), F.min("pos").alias("first"))
    nodes = durable(nodes.select("copy_key", F.xxhash64("copy_key").alias("vid"), "embedding"))
    rotation = fit(nodes, dim, lists)
    askers = nodes
    if asking:
        wanted = members.where(asking).select("copy_key").distinct()
        askers = nodes.join(wanted, "copy_key", "left_semi")
    pairs = candidates(nodes, askers, rotation, dim, k, spread, floor, eps)
    links = durable(rerank(pairs, nodes, dim, floor))

    # the k + 1 first members of every class: enough for any ranking, whatever the size of the class
    keyed = members.withColumn("vid", F.xxhash64("copy_key")).select("vid", "id", "pos")
    by_pos = Window.partitionBy("vid").orderBy("pos")
    heads = keyed.withColumn("rn", F.row_number().over(by_pos)).where(F.col("rn") <= k + 1).select("vid", F.col("id").alias("other_id"), F.col("pos").alias("other_pos"))
    directed = links.select(F.col("a").alias("vid"), F.col("b").alias("other"), "cos").unionByName(links.select(F.col("b").alias("vid"), F.col("a").alias("other"), "cos"))
    sizes = keyed.groupBy("vid").agg(F.count("*").alias("copies"))
    shared = heads.join(sizes.where("copies > 1"), "vid").select("vid", "other_id", "other_pos", F.lit(1.0).alias("cos"))
    apart = directed.join(heads.withColumnRenamed("vid", "other"), "other").select("vid", "other_id", "other_pos", "cos")
    best = Window.partitionBy("vid").orderBy(F.desc("cos"), "other_pos")
    listed = shared.unionByName(apart).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = listed.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("place", "other_id", "cos"))).alias("listed")).join(sizes, "vid")
    asked = keyed.where(asking) if asking else keyed
    total = keyed.count()
    joined = attach_by_key(asked.select("vid", "id"), listed, "vid", "copies", total)
    own = F.slice(F.filter("listed", lambda x: x["other_id"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(own).alias("rank", "x")).select("id", F.col("x.other_id"), F.col("x.cos"), (F.col("rank") + 1).alias("rank"))
