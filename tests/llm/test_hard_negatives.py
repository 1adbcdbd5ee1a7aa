import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, dim string, top long, score double"
LIMIT = (1 << 63) - 1


def relabel(vec_id, label):
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def brute(rows, every=100, k=5):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        v = [float(c) for c in v]
        held[i] = min(held.get(i, (v, label)), (v, label))
    table = [(i, [Fraction(c) * 256 // 1 for c in v], (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in held.items()]
    out = []
    for a, av, al in table:
        if a % every:
            continue
        scored = []
        for i, v, label in table:
            if i != a and len(v) == len(av):
                s = max(-LIMIT - 1, min(LIMIT, sum(x * y for x, y in zip(v, av, strict=True))))
                scored.append((-s, i, label))
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == al][:k]:
            fits = [(i, -t) for t, i, label in scored if label != al and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, n + 1, i, int(-s), int(t)) for n, (i, t) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, **kwargs):
    frame = spark.createDataFrame([(*r, 1, "d", 2, 0.5) for r in rows], SCHEMA)
    found = H.mine(spark, frame.repartition(3), relabel=relabel, **kwargs)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors(rng, n, dim, centres=12):
    base = rng.normal(size=(centres, dim))
    near = rng.integers(0, centres, n)
    return (base[near] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32), near % 5


@pytest.mark.parametrize(("dim", "shard_rows", "window"), [(16, None, 32), (9, 150, 16), (1, 200, 16), (16, 700, 1024)])
def test_brute_force(spark, monkeypatch, dim, shard_rows, window):
    monkeypatch.setattr(H, "WINDOW", window)
    monkeypatch.setattr(H, "LEAST_ROWS", 400)
    monkeypatch.setattr(H, "CODEWORDS", 6)
    x, labels = vectors(np.random.default_rng(dim), 900, dim)
    rows = [(k, [float(c) for c in v], int(label)) for k, (v, label) in enumerate(zip(x, labels, strict=True))]
    assert run(spark, rows, every=20, shard_rows=shard_rows) == brute(rows, 20)


def test_ties_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(H, "WINDOW", 8)
    rng = random.Random(4)
    common = [0.5, -0.25, 0.125, 0.5]
    rows = [(k, common if k % 3 == 0 else [rng.choice([-0.5, 0.0, 0.5]) for _ in range(4)], rng.randrange(3)) for k in range(600)]
    assert run(spark, rows, every=50, shard_rows=130) == brute(rows, 50)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, [0.0, 0.0], 1), (300, [-1.0, -2.0], 1), (400, [], 2), (500, [], 3), (600, [], 2),
        (1, [1.0, None], 1), (2, [1.0, float("nan")], 1), (3, None, 1), (4, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (5, [float("inf"), 1.0], 1),
        (6, [0.9, 1.9], 2), (6, [0.9, 1.9], 2), (8, [0.9, 1.9], 2), (9, [0.95, 1.9], 0), (9, [0.1, 1.9], 0), (10, [1.0, 2.0, 3.0], 1),
        (11, [3e38, -3e38], 2), (12, [3e38, 3e38], 1), (700, [3e30, 1.0], 1), (800, [1e6, 3e5], 1), (13, [9e5, 3e5], 2), (14, [-1e-30, 0.0], 2),
    ]
    assert run(spark, rows) == brute([(i, v and [None if c is None else float(np.float32(c)) for c in v], la) for i, v, la in rows])


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0, 2.0], 1)]) == []


def test_cells_come_in_order_of_their_bounds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    shard = H.Shard(np.arange(3000), np.zeros(3000, np.int64), x)
    q = H.whole_numbers(rng.normal(size=(5, 8)))
    one, two = shard.bounds(q)
    for k in range(5):
        cells = list(shard.cells(one[k], two[k]))
        bounds = [c[0] for c in cells]
        assert bounds == sorted(bounds, reverse=True)
        assert sorted(r for _, a, b in cells for r in range(a, b)) == list(range(3000))
        for bound, a, b in cells:
            assert (shard.v[a:b] @ q[k]).max() <= bound


def test_searches_end_early():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(20, 8)) * 4, 400, axis=0) + 0.01 * rng.normal(size=(8000, 8))
    shard = H.Shard(np.arange(8000), np.arange(8000) % 3, x)
    q = H.whole_numbers(x[:1])
    one, two = shard.bounds(q)
    seen = []
    windows = shard.windows
    shard.windows = lambda *b: (seen.append(len(rows)) or (after, rows) for after, rows in windows(*b))
    ids, _ = H.find_positives(shard, q[0], 0, 0, (one[0], two[0]), 5)
    every = H._scores(shard.v, q[0])
    mine = (shard.labels == 0) & (shard.ids != 0)
    best = np.lexsort((shard.ids[mine], -every[mine]))[:5]
    assert ids.tolist() == shard.ids[mine][best].tolist()
    assert sum(seen) < 4000
