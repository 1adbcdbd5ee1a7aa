from collections import Counter

import pytest

from revlens.llm import mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, shut = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in shut)
        open_ = [s for s in order if s not in shut]
        share = {s: left * weight[s] / sum(weight[z] for z in open_) for s in open_}
        more = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not more:
            return share | {s: 2 * sizes[s] for s in shut}
        shut |= more


def test_targets_and_draws(spark, make_docs):
    rows = [(k, "word " * (1 + k * 7919 % 90), "en", s) for k in range(400) for s in ["a", "b", "c", "ü", None][: 1 + k % 5]]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    out = mixing.mix(spark, make_docs(rows)).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want, taken = brute_targets(sizes), Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    again = mixing.mix(spark, make_docs(rows).repartition(9)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs([(d, t, None, None if k % 4 == 0 else f"s{k % 3}") for k, (d, t) in enumerate(odd_rows)])
    out = mixing.mix(spark, docs).collect()
    assert sorted(r["size"] for r in out) == sorted(len((t or "").split()) for _, t in odd_rows)
    assert all(r["target"] <= 2 * r["source_size"] for r in out)
    repeated = mixing.repeat(spark, docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r["copies"] for r in out)


def test_empty_and_wordless(spark, make_docs):
    assert mixing.mix(spark, make_docs([])).collect() == []
    out = mixing.mix(spark, make_docs([(1, None), (2, " ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_targets_of_many_sources(spark):
    import random

    rng = random.Random(2)
    sizes = {f"host{k}.{'é' if k % 3 else 'e'}": int(10 ** rng.uniform(0, 6)) for k in range(2000)} | {None: 77, "zero": 0}
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.targets(spark, totals).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_words_are_counted_without_a_list_of_them(spark):
    import re

    texts = [None, "", " ", "a", " a", "a ", "w ww w", "a\tb\nc\x0bd\x0ce\rf", "\x0e \x1f\xa0 \u2003x", "\U0001f600 \U0001f600\U0001f600", "$1 \\ w", "x " * 30_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").select("doc_id", mixing.words().alias("n"))
    expected = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["n"] for r in rows.collect()} == expected
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_place_of_ranges_is_a_local_relation(spark):
    """From a list of rows it would be made by Python workers, which then stay in the executors."""
    totals = spark.createDataFrame([("a", 3), ("b", 5), (None, 7)], "source string, source_size long")
    weighed = mixing.weighed(spark, totals)
    plan = weighed._jdf.queryExecution().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert {r["source"]: r["weight"] for r in weighed.collect()} == {"a": 3, "b": 1, None: 2}
