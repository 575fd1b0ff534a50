from __future__ import annotations

import numpy as np

from lorespark.llm.vectors import nearest, usable_vectors

DIM = 32
SCHEMA = "id STRING, pos BIGINT, embedding ARRAY<FLOAT>, rank STRING, cos STRING"


def frame(spark, rows):
    return usable_vectors(spark.createDataFrame([(i, p, e, "x", "y") for i, p, e in rows], SCHEMA), "id", ["pos"], "embedding", DIM)


def brute(vectors, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    return np.argsort(-cos, axis=1)[:, :k], cos


def test_recall_of_flat_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, DIM))
    best, _ = brute(v, 5)
    got = nearest(frame(spark, [(str(i), i, x.tolist()) for i, x in enumerate(v)]), DIM, 5, lists=1, spread=1, eps=3.0, asking="pos.pos % 10 = 0").collect()
    hit = sum(int(r.other_id) in best[int(r.id)] for r in got)
    assert len(got) == 750 and hit / 750 >= 0.95


def test_recall_of_close_pairs_with_lists(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, DIM))
    v = np.concatenate([base, base[:300] + 0.25 * rng.normal(size=(300, DIM))])
    _, cos = brute(v, 5)
    want = {(i, j) for i, j in zip(*np.nonzero(cos >= 0.85), strict=True)}
    got = {(int(r.id), int(r.other_id)) for r in nearest(frame(spark, [(str(i), i, x.tolist()) for i, x in enumerate(v)]), DIM, 5, lists=24, spread=8, floor=0.85, eps=4.0).collect()}
    assert got <= want and len(got & want) >= 0.97 * len(want)


def test_unusable_copies_and_ties(spark):
    one = [1.0] + [0.0] * (DIM - 1)
    near = [1.0, 0.1] + [0.0] * (DIM - 2)
    rows = [(f"c{i}", i, one) for i in range(9)] + [("c0", 50, one), ("n", 60, near), ("z", 61, [0.0] * DIM), ("s", 62, [1.0]), ("u", 63, None), ("q", 64, [float("nan")] * DIM), (None, 65, one)]
    got = nearest(frame(spark, rows), DIM, 3, lists=1, spread=1, floor=0.85).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.id, []).append(r.other_id)
    assert by["c0"] == ["c1", "c2", "c3"] and by["c8"] == ["c0", "c1", "c2"] and by["n"] == ["c0", "c1", "c2"] and set(by) == {f"c{i}" for i in range(9)} | {"n"}
    assert nearest(frame(spark, rows[:0]), DIM, 3, lists=4, spread=2, floor=0.85).isEmpty()


def test_crowds_are_told_apart_by_whole_vectors(spark):
    rng = np.random.default_rng(5)
    tight = rng.normal(size=DIM) + 0.05 * rng.normal(size=(400, DIM))
    v = np.concatenate([tight, rng.normal(size=(200, DIM))])
    best, cos = brute(v, 5)
    want = {(i, int(j)) for i in range(len(v)) for j in best[i] if cos[i, j] >= 0.85}
    near = nearest(frame(spark, [(str(i), i, x.tolist()) for i, x in enumerate(v)]), DIM, 5, lists=4, spread=4, floor=0.85, eps=4.0)
    got = {(int(r.id), int(r.other_id)) for r in near.collect()}
    assert len(got) == 2000 and len(got & want) >= 0.98 * len(want)
