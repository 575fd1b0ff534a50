"""Filling fixed-capacity containers: hierarchical multi-length packing.

Sizes are tokens of a public tokenizer, counted in Arrow batches. Documents are routed to tiers of context sizes (``windows``, the longest is the
container): each goes to the shortest window that holds it. Every tier is packed into windows of its own size, longest tier first, and what room
its windows leave is filled from the shorter tiers before these open windows of their own; attention never spans two windows, so a short
text is never paid for at the price of a long one. Windows are then put together to containers: equal ones halve and quarter
a container exactly. A document larger than the capacity is divided, and only then: its full pieces are full containers, its rest is an item
like any other, and each piece says which tokens it holds.

Only (id, size) rows are shuffled, into shards that a hash keeps at about ``shard_items`` each, so that no task sees an unbounded group however
large the corpus; this costs at most one badly filled container a shard. Containers are dealt to step groups over all shards: in the order of their
attention cost (squares of the windows' fill), to and fro, by their place in a range-partitioned order, so that all groups take equally long.

Defined results: null and token-free texts are left out; repeated ids are packed once each row; ties break by id. Shards depend on the order
of the table of sizes, which is written before it is packed.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.plans.durable import durable

SETTING, VOCABULARY = "spark.lorespark.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"
WINDOWS = (2048, 1024, 512)
#: Fixed value: the published word pattern of this vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = "doc_id BIGINT, piece_no INT, n_tokens INT, first_token INT, tier INT, container_id STRING, window_no INT, window INT"


def shipped_vocabulary(spark: SparkSession) -> str:
    """The name of the vocabulary file that the setting names, sent to every executor with the job."""
    path = spark.conf.get(SETTING, VOCABULARY)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    encoding = tokenizer(vocabulary)
    return lambda text: len(encoding.encode_ordinary(text))


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every document that has a token. ``docs`` has doc_id and text."""
    name = shipped_vocabulary(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = token_counter(SparkFiles.get(name))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [size(t) for t in batch["text"]]})

    usable = docs.where("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return usable.mapInPandas(count, "doc_id BIGINT, n_tokens INT").where("n_tokens > 0")


def as_items(sizes: DataFrame, capacity: int) -> DataFrame:
    """One row per piece: documents over the capacity become full pieces and a rest, all others stay whole."""
    pieces = F.sequence(F.lit(1), F.ceil(F.col("n_tokens") / capacity).cast("int"))
    rest = F.col("n_tokens") - (F.col("piece_no") - 1) * capacity
    return sizes.select("doc_id", "n_tokens", F.explode(pieces).alias("piece_no")).select(
        "doc_id", "piece_no", F.least(rest, F.lit(capacity)).cast("int").alias("n_tokens")
    )


def tier_of(size: int, windows: tuple[int, ...]) -> int:
    """The shortest window that holds ``size``."""
    return min(w for w in windows if w >= size)


def pack_shard(items: list[tuple[int, int, int]], windows: tuple[int, ...]) -> list[list[tuple[int, list[int]]]]:
    """Containers of (window, positions in ``items``); items are (doc_id, piece_no, n_tokens), windows fall and each divides the one before."""
    by_tier: dict[int, list[int]] = {w: [] for w in windows}
    for i, item in enumerate(items):
        by_tier[tier_of(item[2], windows)].append(i)
    filled: list[tuple[int, list[int]]] = []
    gaps: list[tuple[int, int]] = []  # (free, window), sorted
    for window in windows:
        for i in sorted(by_tier[window], key=lambda i: (-items[i][2], items[i][0], items[i][1])):
            size = items[i][2]
            at = bisect_left(gaps, (size, -1))  # the smallest gap that is large enough, in this tier's windows or a longer one's
            if at < len(gaps):
                free, w = gaps.pop(at)
            else:
                free, w = window, len(filled)
                filled.append((window, []))
            filled[w][1].append(i)
            if free > size:
                insort(gaps, (free - size, w))
    containers: list[list[tuple[int, list[int]]]] = []
    room = 0
    for w in filled:  # from long to short, so every container is filled before the next
        if room < w[0]:
            containers.append([])
            room = windows[0]
        containers[-1].append(w)
        room -= w[0]
    return containers


def pack(sizes: DataFrame, windows: tuple[int, ...] = WINDOWS, groups: int = 8, shard_items: int = 20_000) -> DataFrame:
    """Every item with its window and container (``PACKED``) and its ``step_group``."""
    if any(a % b for a, b in zip(windows, windows[1:], strict=False)) or not windows:
        raise ValueError("windows must fall, and each must divide the one before")
    capacity = windows[0]
    items = as_items(sizes, capacity)
    expected = sizes.agg(F.coalesce(F.sum(F.ceil(F.col("n_tokens") / capacity)), F.lit(0))).first()[0]
    shards = max(1, -(-int(expected) // shard_items))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        rows = list(zip(pdf["doc_id"].tolist(), pdf["piece_no"].tolist(), pdf["n_tokens"].tolist(), strict=True))
        out = [
            (*rows[i], (rows[i][1] - 1) * capacity + 1, tier_of(rows[i][2], windows), f"{shard}-{c}", n, window)
            for c, held in enumerate(pack_shard(rows, windows))
            for n, (window, members) in enumerate(held, 1)
            for i in members
        ]
        return pd.DataFrame(out, columns=[x.split()[0] for x in PACKED.split(", ")])

    # the place of the row is hashed too, so that an id which is given very often doesn't own a shard
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    packed = durable(sharded.groupBy("shard").applyInPandas(pack_group, PACKED))
    return packed.join(step_groups(packed, groups), "container_id").select(*packed.columns, "step_group")


def step_groups(packed: DataFrame, groups: int) -> DataFrame:
    """(container_id, cost, step_group): containers by falling cost, dealt to and fro, over the whole corpus."""
    fill = packed.groupBy("container_id", "window_no").agg(F.sum("n_tokens").alias("fill"))
    costs = fill.groupBy("container_id").agg(F.sum(F.col("fill") * F.col("fill")).alias("cost"))
    parts = packed.sparkSession.sparkContext.defaultParallelism
    ordered = durable(costs.repartitionByRange(parts, F.desc("cost"), "container_id").withColumn("part", F.spark_partition_id()))
    # one row a range; the ranges hold about as many containers each
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.desc("cost"), "container_id")
    place = ordered.withColumn("n", F.row_number().over(inside)).join(F.broadcast(starts), "part").withColumn("at", F.pmod(F.col("start") + F.col("n") - 1, F.lit(2 * groups)))
    return place.select("container_id", "cost", F.least("at", 2 * groups - 1 - F.col("at")).cast("int").alias("step_group"))


def piece_texts(docs: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, text) of the documents that were divided: the characters of each piece's tokens; together they are the text."""
    name = shipped_vocabulary(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(SparkFiles.get(name))
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                _, offsets = encoding.decode_with_offsets(encoding.encode_ordinary(text))
                starts = offsets[::capacity] + [len(text)]
                rows += [(doc, n, text[a:b]) for n, (a, b) in enumerate(zip(starts, starts[1:], strict=False), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "text"])

    large = sizes.where(F.col("n_tokens") > capacity).select("doc_id").distinct()
    return docs.select(F.col("doc_id").cast("bigint"), "text").where("text <> ''").join(large, "doc_id", "left_semi").mapInPandas(cut, "doc_id BIGINT, piece_no INT, text STRING")
