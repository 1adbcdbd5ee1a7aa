import random
import re

import numpy as np
import pytest

from revlens.llm import licenses
from revlens.llm import shingles as S
from tests.llm.conftest import words

LONG = "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"


def brute(text, templates):
    """Licenses with a window on the grid that holds enough of the template."""
    tokens = licenses.tokens(text or "")
    grams = S.shingle_hashes(tokens, licenses.WIDTH) if len(tokens) >= licenses.WIDTH else np.zeros(0, np.uint64)
    found = {}
    for group in licenses.prepare(templates):
        span = 2 * group.words - licenses.WIDTH + 1
        for name, own in zip(group.names, group.sets, strict=True):
            shared = [len(np.intersect1d(np.unique(grams[k : k + span]), own)) for k in range(0, max(len(grams), 1), group.words)]
            if max(shared, default=0) / len(own) >= licenses.CONTAINMENT:
                found[name] = max(shared)
    return found


def test_odd_rows_and_planted_notices(spark, make_docs, odd_rows):
    rng = random.Random(3)
    templates = licenses.TEMPLATES | {"permission": LONG}
    rows = list(odd_rows)
    for k in range(200):
        text = words(rng, rng.randrange(200)).split()
        for name in rng.sample(sorted(templates), rng.randrange(3)):
            notice = templates[name].split()
            if rng.random() < 0.3:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = notice
        rows.append((100 + k, " ".join(text)))
    rows.append((400, words(rng, 30_000) + " " + LONG.upper() + " " + words(rng, 30_000)))
    out = licenses.scan(make_docs(rows).repartition(4), templates).collect()
    got = {}
    for r in out:
        assert r["containment"] >= licenses.CONTAINMENT
        got.setdefault((r["doc_id"]), {})[r["license"]] = r["shared"]
    want = {d: brute(t, templates) for d, t in rows}
    assert got == {d: f for d, f in want.items() if f}
    assert got[400]["permission"] == len(LONG.split()) - licenses.WIDTH + 1


def plain_windows(text, template):
    """Most template shingles in any stretch of the text as long as the template, from strings alone."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    own, told = cut(text or ""), cut(template)
    grams = {tuple(told[k : k + 3]) for k in range(len(told) - 2)}
    at = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    hits = [k for k, g in enumerate(at) if g in grams]
    span = len(told) - 2
    most = lambda width: max((len({at[h] for h in hits if k <= h < k + width}) for k in hits), default=0)
    return len(grams), most(span), most(2 * span + 2)


def test_whole_table_against_strings(spark):
    """Every stretch of a template's length that holds enough of it is found, and nothing that no stretch of
    twice the longest length in its group holds; counts are those of some window in between."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    # stretches with some words of every template in them, so that near misses are judged as well
    rng, made = random.Random(11), []
    for k, name in enumerate(sorted(licenses._NOTICES)):
        for part in (0.5, 0.7, 0.85, 1.0):
            notice = licenses._NOTICES[name].split()
            gone = set(rng.sample(range(len(notice)), int((1 - part) * len(notice) / 3)))
            notice = [w for at, w in enumerate(notice) if at not in gone]
            made.append((1_000_000 + 10 * k + int(10 * part), f"{words(rng, 37)} {' '.join(notice).upper()}, {words(rng, 41)}"))
    docs = spark.createDataFrame([*map(tuple, rows), *made], "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["license"]): r["shared"] for r in licenses.scan(docs, licenses._NOTICES).collect()}
    found = 0
    for doc_id, text in [*map(tuple, rows), *made]:
        for name, notice in licenses._NOTICES.items():
            n, least, most = plain_windows(text, notice)
            if 5 * least >= 4 * n:
                assert (doc_id, name) in got, (doc_id, name, least, n)
                found += 1
            if (doc_id, name) in got:
                shared = got[doc_id, name]
                assert 5 * shared >= 4 * n and least <= shared, (doc_id, name)
                if 5 * most < 4 * n:  # only where a longer template of its group widens the window
                    group = next(g for g in licenses.prepare(licenses._NOTICES) if name in g.names)
                    assert group.words > len(notice.split())
    assert found > 60


def test_empty(spark, make_docs):
    assert licenses.scan(make_docs([])).collect() == []


def test_template_bounds(monkeypatch):
    with pytest.raises(ValueError):
        licenses.prepare({"tiny": "too short"})
    monkeypatch.setattr(licenses, "MAX_TEMPLATE_WORDS", 10)
    with pytest.raises(ValueError):
        licenses.prepare({"long": LONG})


def test_bands_guarantee_recall():
    for group in licenses.prepare(licenses.TEMPLATES | {"permission": LONG}):
        for own in group.sets:
            s = licenses.least_similarity(len(own), group.words)
            assert 1 - (1 - s**licenses.ROWS) ** group.bands >= licenses.RECALL


def test_window_bands_match_direct_hashing(monkeypatch):
    group = licenses.prepare({"permission": LONG})[0]
    rng = np.random.default_rng(1)
    for n in (1, 5, 20, 500):
        grams = rng.integers(0, 2**63, n, dtype=np.uint64)
        for step in (licenses.STEP, 3):
            monkeypatch.setattr(licenses, "STEP", step)
            bands, span = licenses.window_bands(grams, group)
            for k, row in enumerate(bands):
                part = grams[k * group.words : k * group.words + span]
                if len(part):
                    assert (row == S.band_hashes(S.min_hashes(part, group.bands * licenses.ROWS), licenses.ROWS)).all()
            assert (len(bands) - 1) * group.words + span >= n


def test_customary_notices_and_whole_texts_are_found(spark, make_docs):
    rng = random.Random(9)
    wanted = {"agpl-header", "cc-by-sa-4.0", "gpl-2.0-header", "gpl-3.0-header", "isc", "lgpl-header", "gpl-3-text", "mpl-2.0-text"}
    docs = [(k, f"{words(rng, 300)}\n{licenses.TEMPLATES[name]}\n{words(rng, 300)}") for k, name in enumerate(sorted(wanted))]
    docs.append((99, words(rng, 20_000)))
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(make_docs(docs)).collect()}
    assert {(k, name) for k, name in enumerate(sorted(wanted))} <= found
    assert all(d != 99 for d, _ in found)
