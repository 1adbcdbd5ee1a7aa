import random
import zlib

import numpy as np

from revlens.llm import language_id

WORDS = {
    "en": "the and of water house running quickly through which would there when shall",
    "de": "der und nicht wasser häuser schnell durch welche würde zwischen über straße",
    "es": "el los niño agua casa corriendo rápidamente también señor cuando será aquí",
}


def sentences(rng, lang, n):
    w = WORDS[lang].split()
    return " ".join(rng.choice(w) for _ in range(n))


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(k, sentences(rng, lang, rng.randrange(5, 60)), lang, "s") for k in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_nulls(spark, make_docs):
    rows = rows_of(600)
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 -- !!", "de", "s"), (None, "the house", "en", "s"),
           (1003, "the water " * 200_000, "en", "s"), (1004, "nicht über straße", None, None), (1004, "nicht über straße", None, None)]
    docs = make_docs(rows + odd).repartition(4)
    out = language_id.identify(spark, docs).collect()
    assert len(out) == len(rows + odd)
    by_id = {r["doc_id"]: r for r in out}
    held = [by_id[r[0]] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(r["held_out"] for r in held)
    assert sum(r["held_out"] for r in out if r["doc_id"] is not None and r["doc_id"] < 600) == len(held)
    lang = {r[0]: r[2] for r in rows}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    for k in (1000, 1001, 1002):
        assert (by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0)
    assert by_id[1003]["lang_pred"] == "en" and by_id[1004]["lang_pred"] == "de"
    assert by_id[None]["held_out"] and by_id[None]["lang_pred"] == "en"
    kept = language_id.keep_identified(spark, docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows + odd) - 3


def test_learns_from_training_rows_only(spark, make_docs):
    rows = rows_of(200)
    swapped = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 5 == 0 else lang, "other") for k, t, lang, _ in rows]
    one = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(spark, make_docs(rows)).collect()}
    two = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(spark, make_docs(swapped).repartition(1)).collect()}
    assert one == two


def test_empty_unlabelled_and_single_language(spark, make_docs):
    assert language_id.identify(spark, make_docs([])).collect() == []
    out = language_id.identify(spark, make_docs([(k, "some text", None, "s") for k in range(8)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    assert language_id.keep_identified(spark, make_docs([(k, "some text", None, "s") for k in range(8)])).count() == 8
    out = language_id.identify(spark, make_docs([(k, "some text", "en", "s") for k in range(8)])).collect()
    assert {r["lang_pred"] for r in out} == {"en"}


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Straße, 12  über\n\nall. " * 50 + "  " + "é" * 40
    whole = language_id._counts(text)
    for block in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert (language_id._counts(text) == whole).all()
    assert language_id._counts("123 ?") is None


def test_penalty_gives_sparse_weights_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        label = k % 2
        at = np.unique(np.append(rng.integers(100, 2000, 20), label))
        rows.append((label, at, np.full(len(at), 1 / np.sqrt(len(at)))))
    weights = language_id.fit(rows, 2)
    assert (weights[2000:-1] == 0).all()
    assert np.abs(weights[:2]).min() > np.abs(weights[100:2000]).max()
    scores = np.repeat([[8.0, 0.0]], 100, axis=0)
    labels = (np.arange(100) >= 75).astype(int)  # right in three of four cases
    heat = language_id.calibrate(scores, labels)
    assert abs(language_id.softmax(scores / heat)[0, 0] - 0.75) < 0.01


def test_one_word_texts_stay_with_two_languages(spark, make_docs):
    rows = [r for r in rows_of(300) if r[2] != "es"]
    odd = [(1000 + k, t, None, None) for k, t in enumerate(["in", "zzz", "жук", "qq", "und", "o", "12", None])]
    kept = {r["doc_id"] for r in language_id.keep_identified(spark, make_docs(rows + odd)).collect()}
    assert {k for k in kept if k >= 1000} == set(range(1000, 1006))
    assert {r[0] for r in rows} <= kept


def test_clashing_columns_stay_as_they_were(spark):
    from tests.llm.conftest import CLASHES

    rows = [(k, t, lang) for k, t, lang, _ in rows_of(60)] + [(100, "12 !!", "en"), (101, None, "en")]
    docs = spark.createDataFrame(
        [(*r, *(f"{c}{r[0]}" for c in CLASHES)) for r in rows],
        "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    kept = language_id.keep_identified(spark, docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect() if r["doc_id"] < 100}


def test_labels_beyond_the_bound_are_not_learned(spark, make_docs, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    rows = rows_of(120) + [(500 + k, f"free text {k}", f"label {k}", "s") for k in range(30)]
    found = language_id.identify(spark, make_docs(rows)).collect()
    assert {r["lang_pred"] for r in found} == set(WORDS)


def plain_features(text, idf):
    """The n-grams of a text by characters, one after another."""
    import math

    letters = [c if c.isalpha() else " " for c in text.lower()]
    chars = [" "] if letters else []
    for c in letters:
        if not (c == " " and chars[-1] == " "):
            chars.append(c)
    if not any(c != " " for c in chars):
        return None
    mixed = lambda c, k: ord(c) * language_id._MIX[k] & 0xFFFFFFFF
    counts = {}
    for at in range(1, len(chars)):
        grams = [mixed(chars[at], 0) * language_id._MIX[1]]
        grams.append((mixed(chars[at - 1], 0) ^ mixed(chars[at], 1)) * language_id._MIX[2])
        if at >= 2:
            grams.append((mixed(chars[at - 2], 0) ^ mixed(chars[at - 1], 1) ^ mixed(chars[at], 2)) * language_id._MIX[0])
        for g in grams:
            bucket = (g & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS)
            counts[bucket] = counts.get(bucket, 0) + 1
    counts[(mixed(" ", 0) * language_id._MIX[1] & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS)] = (
        counts.get((mixed(" ", 0) * language_id._MIX[1] & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS), 0) + 1
    )
    value = {b: (1 + math.log(n)) * idf[b] for b, n in counts.items()}
    size = math.sqrt(sum(v * v for v in value.values()))
    return {b: v / size for b, v in value.items()}


def test_features_equal_a_plain_version():
    rng = random.Random(4)
    idf = np.random.default_rng(1).uniform(1, 5, language_id.BUCKETS)
    texts = ["a", "Ab c", "  x--y ", "Straße, 12 über!", "日本 語", "12", ""] + [sentences(rng, lang, 12) for lang in WORDS]
    for text in texts:
        found, want = language_id.features(text, idf), plain_features(text, idf)
        if want is None:
            assert found is None
            continue
        assert found[0].tolist() == sorted(want)
        assert np.allclose(found[1], [want[b] for b in sorted(want)])


def test_steps_equal_a_plain_version():
    """FTRL-proximal with one dictionary entry per coordinate and class."""
    import math

    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        at = np.unique(rng.integers(0, 60, 8))
        rows.append((int(rng.integers(0, 3)), at, rng.uniform(0.1, 1, len(at))))
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= language_id.L1:
            return 0.0
        sign = 1 if z[key] > 0 else -1
        return (sign * language_id.L1 - z[key]) / ((language_id.BETA + math.sqrt(n[key])) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.EPOCHS):
        for label, at, value in rows:
            features = [*zip(at.tolist(), value.tolist(), strict=True), (language_id.BUCKETS, 1.0)]
            held = {(b, c): weight((b, c)) for b, _ in features for c in range(3)}
            scores = [sum(v * held[b, c] for b, v in features) for c in range(3)]
            top = max(scores)
            p = [math.exp(s - top) for s in scores]
            for b, v in features:
                for c in range(3):
                    g = v * (p[c] / sum(p) - (c == label))
                    old = n.get((b, c), 0.0)
                    n[b, c] = old + g * g
                    z[b, c] = z.get((b, c), 0.0) + g - (math.sqrt(n[b, c]) - math.sqrt(old)) / language_id.ALPHA * held[b, c]
    found = language_id.fit(rows, 3)
    for (b, c) in z:
        assert abs(found[b, c] - weight((b, c))) < 1e-9
    assert np.count_nonzero(found) == sum(weight(k) != 0 for k in z)
