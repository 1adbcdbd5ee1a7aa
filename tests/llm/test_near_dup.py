import random
from collections import defaultdict

import numpy as np

from revlens.llm import near_dup
from revlens.llm import shingles as S
from tests.llm.conftest import words


def shingle_set(text):
    w = (text or "").split()
    n = min(5, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, similarity=0.8):
    """{(doc_id, text): (class_id, copy_id, n_links)} with every pair compared."""
    sets = [shingle_set(t) for _, t in rows]
    first = list(range(len(rows)))

    def find(k):
        while first[k] != k:
            k = first[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                first[max(x, y)] = min(x, y)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    members, equal = defaultdict(list), defaultdict(list)
    for k, (d, _) in enumerate(rows):
        members[find(k)].append(d)
        equal[sets[k]].append(d)
    return sorted(
        (str(d), str(least(members[find(k)])), str(least(equal[sets[k]]) if sets[k] else d), links[k])
        for k, (d, _) in enumerate(rows)
    )


def result(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), str(r["copy_id"]), r["n_links"]) for r in df.collect())


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).repartition(4)
    assert result(near_dup.join(spark, docs)) == brute(odd_rows)
    kept = near_dup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    sets = {shingle_set(t) for t in texts}
    assert sum(1 for t in texts if not (t or "").split()) == sum(1 for _, t in odd_rows if not (t or "").split())
    assert all(len(a & b) < 0.8 * len(a | b) for a in sets for b in sets if a != b)


def test_groups_of_many_sizes(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 6)
    rng = random.Random(11)
    rows = []
    for size in (2, 3, 9, 60):
        base = words(rng, 150, 10**6)
        rows += [(0, edited(rng, base, rng.randrange(6))) for _ in range(size)]
    rows += [(0, words(rng, 100, 10**6)) for _ in range(30)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert result(near_dup.join(spark, make_docs(rows))) == brute(rows)


def test_empty(spark, make_docs):
    assert near_dup.join(spark, make_docs([])).collect() == []
    assert near_dup.keep_one(spark, make_docs([(1, None), (2, None)])).count() == 2


def test_recall_of_bands():
    bands = S.bands_for(near_dup.RECALL, near_dup.SIMILARITY, near_dup.ROWS)
    assert 1 - (1 - near_dup.SIMILARITY**near_dup.ROWS) ** bands >= near_dup.RECALL


def test_compare_is_exact():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(40)]
    like = near_dup.compare(sets, 0.3)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert like[a, b] == (len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.3)


def test_word_hashes(monkeypatch):
    text = " ".join(f"word{k % 90}" for k in range(500)) + " " + "x" * 300 + " end"
    whole = S.word_hashes(text)
    assert len(whole) == 502 and len(set(whole.tolist())) == 92
    assert (S.word_hashes("word3\n\tword4  ") == whole[3:5]).all()
    assert len(S.word_hashes(" \n ")) == 0
    monkeypatch.setattr(S, "BLOCK", 310)
    assert (S.word_hashes(text) == whole).all()
    monkeypatch.setattr(S, "BLOCK", 256)  # less than the long word, which is hashed by itself then
    blocks = S.word_hashes(text)
    assert (np.delete(blocks, 500) == np.delete(whole, 500)).all()
    rng = random.Random(1)
    every = {"".join(rng.choice("ab") for _ in range(n)) for n in (1, 7, 8, 9, 15, 16, 17, 40, 1024, 1025, 3000) for _ in range(60)}
    assert len(set(S.word_hashes(" ".join(sorted(every))).tolist())) == len(every)
    assert S.word_hashes("x " + "é" * 2000)[1] == S.word_hashes("é" * 2000)[0]


def test_words_that_collide_in_a_polynomial_differ(spark, make_docs):
    """The pattern abba baab ... of 1,024 letters and its complement share every polynomial hash modulo 2**64."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    assert S.word_hashes(one) != S.word_hashes(two)
    found = near_dup.join(spark, make_docs([(1, one), (2, two)])).collect()
    assert [r["n_links"] for r in found] == [0, 0]


def test_many_bands(spark, make_docs):
    """At a similarity of 0.45 there are 495 bands; every planted pair is found."""
    assert S.bands_for(near_dup.RECALL, 0.45, near_dup.ROWS) > 400
    rng = random.Random(21)
    rows = []
    for k in range(60):
        base = words(rng, 60, 10**6)
        rows += [(2 * k, base), (2 * k + 1, edited(rng, base, 4))]
    got = result(near_dup.join(spark, make_docs(rows), similarity=0.45))
    assert got == brute(rows, 0.45)
    assert sum(r[3] for r in got) >= 80


def test_repeated_rows_without_an_id(spark, make_docs):
    rng = random.Random(5)
    base = words(rng, 80, 10**6)
    rows = [(None, base)] * 200 + [(7, base)] * 50 + [(k, edited(rng, base, 1)) for k in range(20, 40)] + [(None, words(rng, 30, 10**6))] * 3
    assert result(near_dup.join(spark, make_docs(rows).repartition(6))) == brute(rows)
    # rows that repeat the kept id and text stay, as one document
    assert near_dup.keep_one(spark, make_docs(rows)).count() == 50 + 3


def test_pairs_in_several_groups_are_counted_once():
    import pandas as pd

    own = np.arange(50, dtype=np.uint64).tobytes()
    unit = pd.DataFrame({
        "group": 5, "low": 0, "high": 0, "side": 0, "node": [1, 2, 3], "groups": [[3, 5], [3, 5], [5, 9]], "copies": [1, 10, 100], "own": own,
    })
    found = near_dup.judge_unit(unit, 0.8)
    assert dict(zip(found["node"], found["links"], strict=True)) == {1: 100, 2: 100, 3: 11}
    parts = [unit.assign(group=g) for g in (1, 2, 2, 2)]
    frames = [parts[0], pd.concat([parts[1].iloc[:1]]), parts[1].iloc[1:], parts[2].assign(low=1, high=1)]
    assert [len(f) for f in near_dup._by_unit(iter(frames), 0.8)] == [9]


def test_a_cluster_is_mostly_one_group(spark, make_docs):
    rng = random.Random(2)
    base = words(rng, 200, 10**6)
    rows = [(k, edited(rng, base, 2)) for k in range(150)] + [(1000 + k, words(rng, 100, 10**6)) for k in range(50)]
    bands = S.bands_for(near_dup.RECALL, near_dup.SIMILARITY, near_dup.ROWS)
    from pyspark.sql import functions as F

    nodes = near_dup.signatures(make_docs(rows), bands, near_dup.ROWS, near_dup.WIDTH).withColumn("node", F.col("doc_id"))
    groups = near_dup.groups_of(spark, nodes.filter("doc_id < 1000"))
    mean = groups.select(F.avg(F.size("groups"))).first()[0]
    assert mean < 4


def test_clashing_columns_stay_as_they_were(spark):
    from tests.llm.conftest import CLASHES

    docs = spark.createDataFrame(
        [(k, t, *(f"{c}{k}" for c in CLASHES)) for k, t in [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here"), (3, "other words here")]],
        "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    kept = near_dup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    rows = {tuple(r) for r in kept.collect()}
    assert rows <= {tuple(r) for r in docs.collect()} and {r[0] for r in rows} == {1, 3}
