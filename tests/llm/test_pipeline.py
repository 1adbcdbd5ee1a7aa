import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, taken = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        taken.append(docs.count())
        if k == 1:
            assert docs.select("text").distinct().count() == taken[-1]
    assert taken[0] >= taken[1] > 0.95 * taken[0] and taken[1] > taken[2] > taken[3]
    out = corpus_pipeline.run(spark, DATA)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.drop("sequence_id", "offset").exceptAll(pieces.drop("sequence_id", "offset")).count() == 0
    assert out.filter("piece = 0").count() == taken[-1]


def plain_near_copies(docs):
    """Of each group of similar texts the document with the least id; every pair is compared whose sizes allow it."""
    sets = []
    for d in docs:
        own = (d["text"] or "").split()
        sets.append({tuple(own[k : k + 5]) for k in range(max(len(own) - 4, 1))} if own else set())
    first = list(range(len(docs)))

    def find(k):
        while first[k] != k:
            k = first[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if not small or 5 * small < 4 * large:
                continue
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (small + large - shared):
                x, y = sorted((find(a), find(b)), key=lambda k: docs[k]["doc_id"])
                first[y] = x
    return [d for k, d in enumerate(docs) if find(k) == k]


def plain_mix(docs):
    """The documents as often as they are taken, with exact targets, every seed tried on every source."""
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    words = Counter()
    for d in docs:
        words[d["source"]] += size(d)
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in words)
    weight, shut = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        open_ = [s for s in order if s not in shut]
        left = Fraction(3, 2) * sum(words.values()) - sum(2 * words[s] for s in shut)
        target = {s: 2 * words[s] if s in shut else left * weight[s] / sum(weight[z] for z in open_) for s in order}
        more = {s for s in open_ if target[s] > 2 * words[s]}
        if not more:
            break
        shut |= more
    out = []
    for s in order:
        own, rate = [d for d in docs if d["source"] == s], Fraction(target[s]) / words[s] if words[s] else 0
        digest = [hashlib.md5(str(d["doc_id"]).encode()).hexdigest() for d in own]
        tries = []
        for seed in range(32):
            draws = [(int(h[:8], 16) + seed * int(h[8:16], 16)) % 2**32 for h in digest]
            times = [int(rate) + (Fraction(n, 2**32) < rate - int(rate)) for n in draws]
            tries.append((abs(sum(size(d) * n for d, n in zip(own, times, strict=True)) - target[s]), seed, times))
        out += [d for d, n in zip(own, min(tries)[2], strict=True) for _ in range(n)]
    return out


def test_run_equals_plain_python(spark):
    """All stages over the whole table, with no code of the operators."""
    from tokenizers import Tokenizer

    import public_tokenizers

    data = "/root/testdata/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = [d for d in docs if any(map(str.isalpha, d["text"] or ""))]
    by_text = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        by_text[d["text"]] = d
    kept = plain_near_copies(list(by_text.values()))
    assert len(docs) > len(by_text) > len(kept)
    taken = plain_mix(kept)

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d in taken:
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if k == 0 else a + 2048]
            want[d["doc_id"], k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), tuple(part)] += 1
    got, places = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(places) <= -(-sum(k[3] * n for k, n in want.items()) // 2048) + 2


def test_empty_and_odd(spark, make_docs, odd_rows, tmp_path):
    for rows in ([], odd_rows):
        docs = make_docs(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == make_docs([]).columns
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_clashing_columns_pass_every_stage(spark, tmp_path):
    from tests.llm.conftest import CLASHES, words

    rng = random.Random(3)
    rows = [(k, words(rng, 40), "en", f"s{k % 2}") for k in range(12)]
    rows += [(20, rows[0][1], "en", "s0"), (21, rows[1][1] + " end", "en", "s1")]
    docs = spark.createDataFrame(
        [(*r, *(f"{c}{r[0]}" for c in CLASHES)) for r in rows],
        "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    before = {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        docs = kept
        assert {tuple(r) for r in docs.collect()} <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 10


def test_full_outputs_are_made(spark, monkeypatch):
    from pyspark.sql import functions as F

    from revlens.llm import packing, queries, suffix_dedup

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(50)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in pieces)

    pack, deduplicate = packing.pack, suffix_dedup.deduplicate
    plain = [{tuple(r) for r in q(spark, DATA).collect()} for q in (queries.op2_best_fit_packing, queries.op8_suffix_dedup)]
    assert {r[:5] for r in plain[0]} == {tuple(r)[:5] for r in pack(spark, spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    # digests are of the ids and bytes returned
    monkeypatch.setattr(packing, "pack", lambda *a, **k: pack(*a, **k).withColumn("ids", F.array(F.lit(1))))
    monkeypatch.setattr(suffix_dedup, "deduplicate", lambda *a, **k: deduplicate(*a, **k).withColumn("kept", F.lit(b"x")))
    assert {r["ids_crc32"] for r in queries.op2_best_fit_packing(spark, DATA).collect()} == {zlib.crc32(b"\1\0\0\0")}
    assert len({r["kept_sha256"] for r in queries.op8_suffix_dedup(spark, DATA).collect()}) == 1


def test_stages_bound_the_batches_of_workers(spark, make_docs):
    """Long rows go to a Python worker a few megabytes at once, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    few = make_docs([(k, f"some words of text number {k}") for k in range(20)])
    long_rows = spark.range(4000).coalesce(1).selectExpr("id", "repeat('x', 4000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    def largest():
        return max(r["bytes"] for r in long_rows.mapInArrow(sizes, "bytes long").collect())

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, few, DATA)
        assert largest() < 5 << 20, name
    spark.conf.set(key, str(1 << 20))
    corpus_pipeline.mix(spark, few, DATA)
    assert largest() < 2 << 20
    spark.conf.unset(key)
