from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import packing as P
from lorespark.llm.splitting import split_oversized, split_spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #\n.-é́\r", max_size=600), st.integers(10, 80), st.integers(0, 12))
def test_pieces_cover_the_text(text, size, overlap):
    spans = split_spans(text, size, overlap)
    assert "".join(text[a:b] for _, a, b in spans) == text
    assert all(b - lead <= size and a - lead <= overlap for lead, a, b in spans)


def test_structure_is_kept():
    text = "# A\n" + "one two. " * 8 + "\n# B\n" + "x y. " * 5 + "\n- item\n- item"
    spans = split_spans(text, 90, 0)
    assert [text[a : a + 3] for _, a, _ in spans] == ["# A", "# B"]
    assert [b - a for _, a, b in split_spans("x" * 100, 30, 5)] == [25, 25, 25, 25]


def test_split_cases(spark):
    df = spark.createDataFrame([(1, "w " * 100, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (None, "w " * 100, "x")], "raw_id BIGINT, text STRING, item_id STRING")
    out = split_oversized(df, "raw_document", F.col("raw_id"), F.col("text"), 60, 10).orderBy("piece_no").collect()
    assert {r.item_id for r in out} == {"1"} and out[0].start_pos == 1 and out[-1].end_pos == 200
    assert split_oversized(df.limit(0), "k", F.col("raw_id"), F.col("text"), 60, 10).isEmpty()
    with pytest.raises(ValueError):
        split_oversized(df, "k", F.col("raw_id"), F.col("text"), 1, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_shard_packing(sizes):
    items = [(i, 1, n) for i, n in enumerate(sizes)]
    containers = P.pack_shard(items, (100, 50, 25))
    assert sorted(i for c in containers for _, members in c for i in members) == list(range(len(sizes)))
    assert all(sum(w for w, _ in c) <= 100 for c in containers)
    assert all(sum(sizes[i] for i in members) <= w and all(P.tier_of(sizes[i], (100, 50, 25)) <= w for i in members) for c in containers for w, members in c)
    if sizes:
        assert len(containers) <= 2 * -(-sum(sizes) // 100) + 1


def test_tiers_make_a_difference():
    items = [(i, 1, n) for i, n in enumerate([70, 40, 30, 20, 10, 8, 6])]
    tiered, plain = P.pack_shard(items, (100, 50, 25)), P.pack_shard(items, (100,))
    windows = [(w, [items[i][2] for i in m]) for c in tiered for w, m in c]
    assert windows == [(100, [70, 30]), (50, [40, 10]), (25, [20]), (25, [8, 6])]  # the long gap goes to a shorter tier, and attention stays in its window
    assert [[items[i][2] for i in m] for c in plain for _, m in c] == [[70, 30], [40, 20, 10, 8, 6]]


def test_pack(spark):
    docs = spark.createDataFrame([(i, "word " * (3 + i * 37 % 400), "z") for i in range(300)] + [(900, "long wörds " * 2000, "z"), (901, None, "z"), (902, "", "z"), (5, "again", "z")], "doc_id BIGINT, text STRING, tier STRING")
    sizes = P.with_sizes(docs)
    out = P.pack(sizes, (512, 256, 128), shard_items=100).collect()
    used, total, windows = {}, {}, {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        windows[r.container_id, r.window_no, r.window] = windows.get((r.container_id, r.window_no, r.window), 0) + r.n_tokens
    expected = {}
    for r in sizes.collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + r.n_tokens
    assert total == expected and max(used.values()) <= 512 and all(fill <= k[2] for k, fill in windows.items())
    assert sum(used.values()) / (512 * len(used)) > 0.85
    assert {r.doc_id for r in out if r.piece_no > 1} == {900} and {r.first_token % 512 for r in out} == {1}
    cost = {}
    for (c, _, _), fill in windows.items():
        cost[c] = cost.get(c, 0) + fill * fill
    group_of = {r.container_id: r.step_group for r in out}
    sums = [sum(x for c, x in cost.items() if group_of[c] == g) for g in range(8)]
    assert set(group_of.values()) == set(range(8)) and max(sums) - min(sums) <= max(cost.values())
    pieces = P.piece_texts(docs, sizes, 512).orderBy("doc_id", "piece_no").collect()
    assert "".join(r.text for r in pieces) == "long wörds " * 2000 and len(pieces) == sum(r.doc_id == 900 for r in out)
    assert P.pack(sizes.limit(0)).isEmpty()


def test_windows_must_divide(spark):
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], "doc_id BIGINT, n_tokens INT"), (100, 30))
