import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlens.llm import lm_scoring as L
from tests.llm.conftest import words


def is_held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def brute(rows, order=L.ORDER):
    """Scores from dictionaries, symbol by symbol."""
    texts = [(d, (t or "").encode().lower()) for d, t in rows]
    seen, tokens = defaultdict(Counter), Counter()
    train = [t for d, t in texts if not is_held_out(d)]

    def steps(text):
        every = bytes([L.START]) * order + text + bytes([L.END])
        for k in range(order, len(every)):
            yield every[k - order : k], every[k]

    for t in train:
        tokens.update([*t.split(), None])
        for context, symbol in steps(t):
            for k in range(order + 1):
                seen[context[order - k :]][symbol] += 1

    def probability(context, symbol):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            own = {s: n for s, n in seen[context[order - k :]].items() if s not in excluded}
            n, d = sum(own.values()), len(own)
            if symbol in own:
                return p * own[symbol] / (n + d)
            if d:
                p *= d / (n + d)
            excluded |= set(own)
        return p / (256 - len(excluded))

    total, kinds = sum(tokens.values()), len(tokens)
    out = []
    for d, t in texts:
        own = [tokens[w] for w in [*t.split(), None]]
        out.append((
            str(d), is_held_out(d), len(own), sum(map(bool, own)), total,
            sum(math.log10((c + 1) / (total + kinds + 1)) for c in own), sum(math.log10(probability(*s)) for s in steps(t)),
        ))
    return sorted(out), probability


def compare(df, rows):
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((str(r[0]), *r[1:]) for r in df.collect())
    want, _ = brute(rows)
    got, want = (sorted(x, key=lambda r: (r[0], r[2], round(r[6], 6))) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    rows = [(k, words(rng, rng.randrange(40), 30) + rng.choice(["", " Été!", "\n\x0b\x1fX", " 日本語"])) for k in range(n)]
    return rows + [(k, "the same text again") for k in range(n, n + n // 2)]


def test_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(L, "SHARD_BYTES", 700)
    monkeypatch.setattr(L, "BLOCK", 64)
    rows = corpus()
    compare(L.score(spark, make_docs(rows).repartition(3)), rows)


def test_odd_rows(spark, make_docs, odd_rows):
    rows = [(d, t if t is None or len(t) < 20_000 else t[:20_000]) for d, t in odd_rows]
    compare(L.score(spark, make_docs(rows).repartition(4)), rows)


def test_empty_and_untrained(spark, make_docs):
    assert L.score(spark, make_docs([])).collect() == []
    alone = next(k for k in range(99) if is_held_out(k))
    (r,) = L.score(spark, make_docs([(alone, "ab c")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)
    assert r["base_score"] == 0.0 and r["score"] == pytest.approx(5 * math.log10(1 / 256))


def test_very_long_text(spark, make_docs):
    text = "abcdefghij" * 400_000
    one, two, three = [k for k in range(20) if not is_held_out(k)][:3]
    rows = {r["doc_id"]: r for r in L.score(spark, make_docs([(one, text), (two, "abcdefghij"), (three, None)])).collect()}
    assert rows[one]["n_tokens"] == 2 and -30 < rows[one]["score"] < 0
    assert rows[three]["n_tokens"] == 1


def test_probabilities_sum_to_one():
    rng = random.Random(9)
    rows = [(k, words(rng, 12, 9)) for k in range(30)]
    _, probability = brute(rows)
    for context in (b"\xfe\xfe\xfe\xfe", b"w1 w", b"zzzz", b"\xfe\xfew1"):
        assert sum(probability(context, s) for s in range(256)) == pytest.approx(1)


def test_ladder_sums_to_one():
    rng = np.random.default_rng(2)
    text = bytes(rng.choice(np.frombuffer(b"abcd ", np.uint8), 3000))
    keys, counts = np.unique(np.concatenate(list(L.windows_of([text]))), return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, (keys >> 8 * L.ORDER, keys & 255), counts)
    context = int(keys[700]) & ~255
    every = np.union1d(keys, context + np.arange(256))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    p = L.ladder(every, n, pairs, L.low_orders(pairs))
    at = np.searchsorted(every, context + np.arange(256))
    assert p[at].sum() == pytest.approx(1)


def test_better_than_single_bytes_on_held_out(spark, make_docs):
    rng = random.Random(7)
    parts = ["tion", "ment", "an", "er", "qu", "eau", "is", "lo"]
    text = lambda: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(60))
    rows = [(k, text()) for k in range(150)]
    often = Counter(b for k, t in rows if not is_held_out(k) for b in t)
    single = {b: math.log10(n / often.total()) for b, n in often.items()}
    found = {r["doc_id"]: r["score"] for r in L.score(spark, make_docs(rows)).collect()}
    assert all(found[k] > 0.6 * sum(single[b] for b in t) for k, t in rows if is_held_out(k))
