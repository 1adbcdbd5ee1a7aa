import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from revlens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def check(rows, docs, capacity, tokenizer):
    """Whole documents, gapless sequences; returns the number of sequences."""
    expected = defaultdict(int)
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            b = first if k == 0 else a + capacity
            expected[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    found, places = defaultdict(int), defaultdict(list)
    for r in rows:
        found[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == expected
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_odd_rows(spark, make_docs, odd_rows, tokenizer):
    rows = packing.pack(spark, make_docs(odd_rows), capacity=2048).collect()
    n = check(rows, odd_rows, 2048, tokenizer)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1
    by_crc = {r["ids_crc32"]: r["ids"] for r in rows}
    assert all(zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == crc for crc, ids in by_crc.items())


def test_small_capacity_and_special_strings(spark, make_docs, tokenizer):
    texts = ["a  b", "x <|endoftext|> y", " lead", "line\n next\n\n last ", "tab\t x", "", None, "don't we'll", "a\u00a0b \u2003c"]
    docs = [(k, t) for k, t in enumerate(texts)] * 3
    check(packing.pack(spark, make_docs(docs), capacity=8).collect(), docs, 8, tokenizer)


def test_empty(spark, make_docs):
    out = packing.pack(spark, make_docs([]), keep_ids=False)
    assert out.collect() == []
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_fullest_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 80))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        taken = packing.fullest(counts, room)
        assert sum(k * n for k, n in taken.items()) == max(sums)
        assert all(n <= counts[k] for k, n in taken.items())


def test_plan_covers_histogram():
    histogram = {2048: 5, 1024: 3, 700: 9, 1: 40, 1500: 4}
    used = defaultdict(int)
    for combo, times in packing.plan_bins(histogram, 2048):
        assert sum(k * n for k, n in combo.items()) <= 2048
        for k, n in combo.items():
            used[k] += n * times
    assert dict(used) == histogram


def test_rank_file_gives_the_same_ids(tokenizer):
    rng = random.Random(1)
    plain = "".join(c for c in map(chr, range(9, 0x20AD)) if packing._PLAIN.fullmatch(c))
    common = "abcXYZ019 .,'<>|_-\t\n\r éßñ¿«º²ı€’…"
    other = "ſǅΩж中\u3000😀\u00a0"
    encoder = packing.Encoder(packing.tokenizer_path(), packing.tokenizer_path(packing.RANKS[packing.TOKENIZER]))
    texts = ["<|endoftext|>", "a<|endoftext|> b", "don't we'll", "a" * 5000, " " * 3000 + "x", ""]
    for letters in (common, plain + " " * 60, common + other):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_of_blanks(tokenizer):
    encoder = packing.Encoder(packing.tokenizer_path(), packing.tokenizer_path(packing.RANKS[packing.TOKENIZER]))
    n = packing.LONGEST_BLANK
    texts = ["x" + c * 1_500_000 + "y" for c in (" ", "\n", "\t", " \r\n")] + ["x" + " " * k + "y" for k in (n, n + 1)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_of_blanks_are_packed(spark, make_docs, tokenizer):
    docs = [(1, "x" + " " * 1_500_000 + "y"), (2, "\n" * 1_500_000), (3, "a b")]
    check(packing.pack(spark, make_docs(docs)).collect(), docs, packing.CAPACITY, tokenizer)
