from collections import defaultdict

import numpy as np

from revlens.llm import graph_search

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, dim string"


def brute(rows, every, k):
    good = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        v = tuple(float(np.float32(c)) for c in v)
        good[vec_id] = min(good.get(vec_id, v), v)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            away = [(float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in good.items() if i != q and len(x) == len(v)]
            out[q] = sorted(away)[:k]
    return out


def searched(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, "d") for i, v in rows], SCHEMA).repartition(3)
    out = defaultdict(list)
    for r in graph_search.nearest(spark, df, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return dict(out)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 24)) * 4
    x = (centres[rng.integers(0, 25, 4000)] + rng.normal(size=(4000, 24))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    for shard_rows in (4096, 700):
        got, want = searched(spark, rows, shard_rows=shard_rows), brute(rows, 100, 10)
        assert got.keys() == want.keys()
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert hits / (10 * len(want)) >= 0.95
        for q, found in got.items():
            assert found == sorted(found) and len(found) == 10
            exact = {i: s for s, i in want[q]}
            assert all(abs(s - exact[i]) < 1e-12 for s, i in found if i in exact)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [-0.0, 2.0]), (10, [0.0, 2.0]), (100, [1.0, 2.0, 3.0]), (200, [3e38, 1.0]),
            (300, [5.0, 5.0]), (300, [4.0, 4.0]), (11, [1e-40, 1e-40])]
    got, want = searched(spark, rows), brute(rows, 100, 10)
    assert got == {q: f for q, f in want.items() if f}
    assert 100 not in got  # no other vector of three dimensions


def test_common_vector_keeps_the_least_ids(spark):
    rows = [(k, [1.0, 2.0]) for k in range(900)] + [(k, [float(k), 1.0]) for k in range(900, 1000)]
    got, want = searched(spark, rows, shard_rows=100), brute(rows, 100, 10)
    assert got == want


def test_empty(spark):
    assert searched(spark, []) == {}
    assert searched(spark, [(100, [1.0])]) == {}


def test_every_node_can_be_reached():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(50, 8)) * 1e-3 + 100 * k for k in range(20)]).astype(np.float32)
    edges, entries = graph_search.build_graph(x, degree=8, beam=16)
    seen, front = set(entries.tolist()), list(entries)
    while front:
        front = [int(t) for f in front for t in edges[f] if t >= 0 and int(t) not in seen and not seen.add(int(t))]
    assert len(seen) == len(x)


def test_full_shard_with_vectors_of_very_different_size(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:400] *= np.float32(1e-25)
    for big in (3e38, 1e20):
        rows = [(k, v.tolist()) for k, v in enumerate(x)]
        rows[1000] = (1000, [big] + [1.0] * 15)
        rows[1001] = (1001, [1.0, -big] + [1.0] * 14)
        got, want = searched(spark, rows), brute(rows, 100, 10)
        assert got.keys() == want.keys()
        assert [i for _, i in got[1000]] == [i for _, i in want[1000]]
        for q in want:  # equal up to the last bits of a sum
            assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12, atol=0)
            assert len({i for _, i in got[q]} & {i for _, i in want[q]}) >= 9


def test_one_large_query_sees_every_shard(spark):
    rng = np.random.default_rng(12)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(3000, 16)).astype(np.float32))]
    rows[100] = (100, [1e12] * 16)
    got, want = searched(spark, rows, shard_rows=1500), brute(rows, 100, 10)
    assert got[100] == want[100]


def test_shards_grow_with_the_data():
    mb = 1 << 20
    assert graph_search.shards_for(500, 8, 512) == 1
    assert graph_search.shards_for(51_282, 6, 512) == 12  # two a core
    assert graph_search.shards_for(10**6, 1000, 512) == 245  # not below the least rows
    assert graph_search.shards_for(10**9, 1000, 512) == -(-(10**9) // (graph_search.SHARD_BYTES // 512))
    assert graph_search.SHARD_BYTES == 32 * mb and graph_search.shards_for(0, 8, 8) == 1


def test_blocks_not_rows_travel(spark):
    rows = [(k, [float(k % 7), 1.0]) for k in range(3000)]
    df = spark.createDataFrame([(i, v, 0, 1, "d") for i, v in rows], SCHEMA)
    clean = graph_search.clean(df)
    blocks = graph_search.query_blocks(clean.filter("vec_id % 10 = 0"), 50, 3).collect()
    assert sum(len(b["ids"]) // 8 for b in blocks) == 300 and len(blocks) <= 3 + 300 // 50
    assert all(len(b["ids"]) <= 50 * 8 for b in blocks)
