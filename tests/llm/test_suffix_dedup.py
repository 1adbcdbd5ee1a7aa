import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from revlens.llm import suffix_dedup, suffix_samples
from tests.llm.conftest import words


def brute(rows, length=suffix_dedup.LENGTH):
    """Result rows; equal (doc_id, text) rows count as one document."""
    import xxhash

    key = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42) - 2**64 * (xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42) >= 2**63))  # noqa: E731, E501
    seen, done = set(), {}
    for doc_id, text in sorted(rows, key=key):
        if (doc_id, text or "") in done:
            continue
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for k in range(len(raw) - length + 1):
            run = raw[k : k + length]
            if run in seen:
                gone[k + 1 : k + 1 + length] = True
            seen.add(run)
        kept = np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes()
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        done[doc_id, text or ""] = (doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return Counter(done[d, t or ""] for d, t in rows)


def result(spark, docs, **options):
    rows = suffix_dedup.deduplicate(spark, docs, **options).collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


@pytest.mark.parametrize("hot_rows", [suffix_dedup.HOT_ROWS, suffix_dedup.LOOK])
def test_odd_rows(spark, make_docs, odd_rows, hot_rows):
    docs = make_docs(odd_rows).repartition(4)
    assert result(spark, docs, hot_rows=hot_rows) == brute(odd_rows)


@pytest.mark.parametrize("hot_rows", [suffix_dedup.HOT_ROWS, suffix_dedup.LOOK])
def test_shared_passages(spark, make_docs, hot_rows):
    rng = random.Random(8)
    shared = [words(rng, n) for n in (14, 20, 25, 40, 120)]
    rows = []
    for k in range(240):
        parts = [words(rng, rng.randrange(60)) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            cut = rng.randrange(len(passage) // 3)
            parts.insert(rng.randrange(len(parts) + 1), passage[cut:])
        rows.append((k, " ".join(parts)))
    rows += [(300, "ab" * 400), (301, "b" * 350), (302, "\0" * 150), (303, "x" * 99), (304, "x" * 100), (305, "x" * 101)]
    rng.shuffle(rows)
    assert result(spark, make_docs(rows).repartition(5), hot_rows=hot_rows) == brute(rows)


def test_empty(spark, make_docs):
    assert suffix_dedup.deduplicate(spark, make_docs([])).collect() == []


def test_induced_order_finds_equal_runs():
    rng = np.random.default_rng(4)
    reach = suffix_dedup.LENGTH - suffix_dedup.GRAM
    base = bytes(rng.integers(97, 100, reach + suffix_dedup.LENGTH).tolist())
    pairs = []
    for _ in range(300):
        left = base[rng.integers(0, reach) : reach]
        if rng.random() < 0.5:
            left = b"z" * rng.integers(0, 5) + left[rng.integers(0, len(left)) :]
        right = base[reach : reach + rng.integers(suffix_dedup.GRAM, suffix_dedup.LENGTH + 1)]
        if rng.random() < 0.5:
            right = right[: rng.integers(suffix_dedup.GRAM, len(right) + 1)] + b"y" * 70
        pairs.append((right[: suffix_dedup.LENGTH], left[-reach:]))
    pairs.sort(key=lambda p: p[0])
    rank = rng.permutation(len(pairs))
    covered = suffix_dedup.induce([r for r, _ in pairs], [x for _, x in pairs], rank)
    for t in range(reach + 1):
        runs = {}
        for k in sorted(range(len(pairs)), key=lambda k: rank[k]):
            right, left = pairs[k]
            run = (left[len(left) - t :] + right)[: suffix_dedup.LENGTH] if len(left) >= t else b""
            again = len(run) == suffix_dedup.LENGTH and run in runs
            assert covered[k, t] == again
            runs[run] = True


def test_samples_agree_across_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[1000:1400] = 97
    whole = suffix_samples.sample(data, 100, 32)
    monkeypatch.setattr(suffix_samples, "BLOCK", 700)
    for a, b in zip(whole, suffix_samples.sample(data, 100, 32), strict=True):
        assert (a == b).all()
    grams = suffix_samples.gram_hashes(data, 32)
    for k in range(0, len(data) - 99, 97):  # every run picks its leftmost smallest gram
        window = grams[k : k + 69] & ~np.uint64((1 << 21) - 1)
        assert k + int(window.argmin()) in whole[0]


def test_grams_that_the_sample_misses_are_counted(spark, make_docs, monkeypatch):
    rng = random.Random(10)
    passage = words(rng, 16)
    rows = [(k, " ".join(f"{words(rng, rng.randrange(3, 9))} {passage}" for _ in range(40))) for k in range(4)]
    spread, real = [], suffix_dedup.resolve_hot

    def resolve_hot(spark, tuples):
        spread.append(min(r["count"] for r in tuples.groupBy("gram").count().collect()))
        return real(spark, tuples)

    monkeypatch.setattr(suffix_dedup, "hot_grams", lambda rows, hot_rows: [])
    monkeypatch.setattr(suffix_dedup, "resolve_hot", resolve_hot)
    assert result(spark, make_docs(rows).repartition(2), hot_rows=50) == brute(rows)
    assert spread and spread[0] > 50
