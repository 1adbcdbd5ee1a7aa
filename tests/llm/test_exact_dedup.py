import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from revlens.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, d in enumerate(sorted(ids, key=lambda d: d != keep)):
            out[d, keep, len(ids), k == 0, sha] += 1
    return out


def as_counter(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).repartition(5)
    assert as_counter(exact_dedup.find_duplicates(spark, docs)) == brute(odd_rows)
    kept = exact_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    texts = Counter(r["text"] or "" for r in kept.collect())
    assert set(texts.values()) == {1} and set(texts) == {t or "" for _, t in odd_rows}


def test_hot_group_and_small_buckets(spark, make_docs):
    rows = [(k, "hot" if k % 3 == 0 else f"text {k % 50} " * 20) for k in range(600)]
    found = exact_dedup.find_duplicates(spark, make_docs(rows).repartition(7), bucket_bytes=2000)
    assert as_counter(found) == brute(rows)
    assert found.select("bucket").distinct().count() > 5


def test_empty(spark, make_docs):
    assert exact_dedup.find_duplicates(spark, make_docs([])).collect() == []


def test_colliding_keys_are_chained():
    pdf = pd.DataFrame({"owner": 0, "bucket": 0, "key": [1, 1, 1, 2, 2], "text": ["a", "b", "a", "a", "a"], "page": range(5)})
    parts = list(exact_dedup.chain(iter([pdf.iloc[:2], pdf.iloc[2:]])))
    assert pd.concat(parts)["chain"].tolist() == [0, 1, 0, 0, 0]


def test_directory_splits_only_overfull_buckets():
    weights = np.zeros(64)
    weights[:8] = 10  # prefix 000
    weights[40] = 100  # one prefix that no split can divide
    bucket, loads = exact_dedup.grow_directory(weights, 25)
    assert len(bucket) == 64 and (np.diff(bucket) >= 0).all()
    assert loads.sum() == weights.sum()
    assert all(load <= 25 or load == 100 for load in loads)
    assert len(loads) < 16
    one, _ = exact_dedup.grow_directory(weights, 1000)
    assert set(one) == {0}


def test_clashing_columns_stay_as_they_were(spark):
    from tests.llm.conftest import CLASHES

    docs = spark.createDataFrame(
        [(k, t, *(f"{c}{k}" for c in CLASHES)) for k, t in [(1, "same"), (2, "same"), (3, "other"), (3, "other"), (None, None)]],
        "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    kept = exact_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert set(rows) <= {tuple(r) for r in docs.collect()} and Counter(r[0] for r in rows) == {2: 1, 3: 1, None: 1}


def test_owners_and_depth_for_sizes_that_are_not_here():
    mb, tb = 1 << 20, 1 << 40
    assert exact_dedup.depth_for(500 * mb, 32 * mb) == exact_dedup.DEPTH
    assert exact_dedup.depth_for(100 * tb, 32 * mb) == exact_dedup.MAX_DEPTH
    assert exact_dedup.depth_for(2 * tb, 32 * mb) == 18
    assert exact_dedup.owners_for(100 * tb, 32 * mb, 1 << 22, 2000) == 100 * tb // (32 * mb)
    assert exact_dedup.owners_for(100 * tb, 32 * mb, 65_536, 2000) == 65_536  # never more than the buckets
    assert exact_dedup.owners_for(10 * mb, 32 * mb, 1, 200) == 1
    assert exact_dedup.owners_for(0, 32 * mb, 1, 200) == 1


def test_deeper_prefixes_give_the_same(spark, make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "DEPTH", 3)
    rows = [(k, f"text {k % 40} " * 30) for k in range(200)]
    found = exact_dedup.find_duplicates(spark, make_docs(rows).repartition(3), bucket_bytes=1000)
    assert as_counter(found) == brute(rows)
    assert found.select("bucket").distinct().count() > 8
