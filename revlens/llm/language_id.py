"""Language identification: sparse multinomial logistic regression on character n-grams.

* Features: letters in lower case, every run of other characters one blank, n-grams of
  one to three characters hashed to ``BUCKETS`` columns, (1 + log tf) x idf, unit length.
* Document frequencies cover every labelled training document, summed inside the tasks
  before they are shuffled (at most ``BUCKETS`` rows a task).
* The weights are fitted on a sample drawn by hash, in expectation at most
  ``SAMPLE_PER_LANGUAGE`` documents of each language and never more than that times the
  number of languages, by follow-the-regularised-leader steps with an elastic-net
  penalty, in one task. A fifth of the sample takes no part in the steps; it sets the
  temperature that divides the scores, so that the probabilities are calibrated.
* Predictions are one pass over the whole texts without a shuffle.

Only ``text`` and ``lang`` of training rows are learned from; a row is held out when
crc32 of its ``doc_id`` as text leaves 0 modulo ``FOLDS`` (a null id counts as empty
text, and so is held out). At most ``MAX_LANGUAGES`` values of ``lang`` are learned, the most
frequent ones (ties: the first by code point), which bounds the model. Null texts and texts without letters are ``und`` with score
0, as is everything when no labelled row exists; ties go to the first language by code
point. Long texts are read in blocks. An empty table gives an empty result. Further columns
are ignored by ``identify`` and returned as they were by ``keep_identified``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import boxed, map_slices, stored

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
FOLDS = 5
SAMPLE_PER_LANGUAGE = 1500
MAX_LANGUAGES = 256
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
UNKNOWN = "und"
#: Characters taken at once from a long text.
BLOCK = 1 << 20
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _counts(text: str) -> np.ndarray | None:
    """Occurrences per bucket; None without letters."""
    counts = None
    carry = np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le"), dtype=np.uint32)
        letter = _letters()[codes]
        if not letter.any() and counts is None and not carry.size:
            continue
        codes = np.where(letter, codes, np.uint32(32))
        blank = ~letter
        if counts is None:
            counts = np.zeros(BUCKETS, dtype=np.int64)
            codes, blank = np.append(np.uint32(32), codes), np.append(True, blank)
        old = len(carry)
        codes = np.append(carry, codes)
        blank = np.append(carry == 32, blank)
        keep = np.append(True, ~(blank[1:] & blank[:-1]))
        keep[:old] = True
        codes = codes[keep]
        a, b, c = (codes * np.uint32(m) for m in _MIX)
        down = np.uint32(32 - BUCKET_BITS)
        grams = [
            (a[old:] * np.uint32(_MIX[1])) >> down,
            ((a[max(old - 1, 0) : -1] ^ b[max(old, 1) :]) * np.uint32(_MIX[2])) >> down,
            ((a[:-2] ^ b[1:-1] ^ c[2:]) * np.uint32(_MIX[0])) >> down,
        ]
        counts += np.bincount(np.concatenate(grams), minlength=BUCKETS)
        carry = codes[-2:]
    return counts


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    counts = _counts(text) if text else None
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / np.sqrt((value * value).sum())


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text, self.idf) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax((found[1] @ self.weights[found[0]] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights from (class, buckets, values) rows by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    lazily = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for label, at, value in rows:
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            zi, ni = z[at], n[at]
            w = lazily(zi, ni)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return lazily(z, n)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the smallest log loss on scores that took no part in the fit."""
    if not len(labels):
        return 1.0
    loss = lambda log_t: -np.log(softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels] + 1e-300).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per bucket, documents with letters) over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                counts = _counts(text) if text else None
                if counts is not None:
                    seen += counts > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, BUCKETS), "n": np.append(seen[at], n)})

    found = map_slices(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in found.collect():  # one row per bucket
        total[r["bucket"]] = r["n"]
    return total[:BUCKETS], int(total[BUCKETS])


def train(spark: SparkSession, docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    sizes = {r["lang"]: r["n"] for r in most[:MAX_LANGUAGES]}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    if len(most) > MAX_LANGUAGES:
        rows = rows.filter(F.col("lang").isin(languages))
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)) + 1

    number = {lang: k for k, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    drawn = rows.withColumn("draw", F.xxhash64("text", "doc_id")).filter(
        F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) < share[F.col("lang")]
    )

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features(t, idf) for t in pdf["text"]]
            out = [(d, number[lang], *f) for d, lang, f in zip(pdf["draw"], pdf["lang"], made, strict=True) if f is not None]
            yield pd.DataFrame(out, columns=["draw", "label", "at", "value"])

    schema = "draw long, label int, at array<int>, value array<double>"
    sample = map_slices(drawn.select("draw", "lang", "text"), featured, schema, 256)
    sample = sample.orderBy("draw").limit(per_language * len(languages))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [r for pdf in batches for r in pdf.itertuples(index=False, name=None)]
        every.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, r[1]))  # not the order of the draw
        steps = [(r[1], np.asarray(r[2]), np.asarray(r[3])) for k, r in enumerate(every) if k % 5]
        tried = [(r[1], np.asarray(r[2]), np.asarray(r[3])) for k, r in enumerate(every) if k % 5 == 0]
        weights = fit(steps, len(languages))
        scores = np.array([v @ weights[a] + weights[-1] for _, a, v in tried]).reshape(len(tried), len(languages))
        heat = calibrate(scores, np.array([t[0] for t in tried], dtype=np.int64))
        at, k = np.nonzero(weights)
        yield pd.DataFrame({"bucket": np.append(at, -1), "label": np.append(k, 0), "weight": np.append(weights[at, k], heat)})

    weights, heat = np.zeros((BUCKETS + 1, len(languages))), 1.0
    model = stored(spark, sample.coalesce(1).mapInPandas(fitted, "bucket int, label int, weight double"), "language-model")
    found = model.toPandas()  # at most BUCKETS x languages weights
    for bucket, label, weight in found.itertuples(index=False, name=None):
        if bucket < 0:
            heat = weight
        else:
            weights[bucket, label] = weight
    return Model(languages, idf, weights, heat)


def predictor(model: Model):
    """A column function of the text: struct of ``lang_pred`` and ``score``."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]  # one text at a time becomes a string
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"]
        )

    return predict


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    predict = predictor(train(spark, docs))
    rows = docs.select(F.col("doc_id").cast("long"), predict(F.col("text").cast("string")).alias("found"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows whose language can be told, columns as they were.

    Only null texts and texts without letters go, however many languages there are. Without
    any labelled row nothing is learned, and all rows stay.
    """
    model = train(spark, docs)
    if not model.languages:
        return docs
    predict = predictor(model)
    return boxed(docs, found=predict(F.col("text").cast("string"))).filter(F.col("found.lang_pred") != UNKNOWN).select("row.*")
