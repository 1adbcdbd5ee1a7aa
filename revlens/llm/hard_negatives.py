"""Hard negatives through inverted multi-indexes: rows that score almost like a positive.

* Components become floor(256 x); a score is the integer inner product with the anchor.
* Rows are dealt to shards by a hash of their id, of at most ``SHARD_BYTES`` of components.
  A shard is an inverted multi-index: k-means on ``FIT_ROWS`` of its rows (those with the
  smallest ids by hash) gives a codebook for either half of the components, and a pair of
  codewords is a cell. Every row is in the cell of its nearest codewords; every codeword
  has the radius of the half vectors that belong to it.
* For an anchor, a half-score bound is the product with the codeword plus the anchor's
  half norm times the radius. A multi-sequence heap visits the cells in descending order of
  the two bounds' sum, ``WINDOW`` rows at a time; rows are scored exactly, and the search ends
  when the bound of the next cell certifies that no row left can be in the answer.
* Anchors travel in blocks past every shard, which is in memory once; a shard returns a
  few rows per anchor, and the best of all shards are taken. A first pass finds the
  positives, a second one the windows below their scores.

Results are exact, as only certified searches end early. A shard (or an anchor) with components
above ``EXACT``, where products no longer fit double precision, is compared row by row with
whole numbers of any size; a score beyond the range of long counts as its limit.

Rows without an id, label or vector, or with a null or non-finite component, take no part.
Rows that repeat an id count once, with their least vector and label. Vectors are compared
with those of equal dimension only. Fewer than k: all there are; an anchor without a
positive has no rows. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import block_rows, past_shards, stored

SCALE = 256
SHARD_BYTES = 32 << 20
#: Shards are made smaller than that, down to so many rows, until every core has one.
LEAST_ROWS = 4096
FIT_ROWS = 4096
CODEWORDS = 24
ROUNDS = 6
WINDOW = 1024
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53
LONG = (1 << 63) - 1
K = 5
LOW, HIGH = 80, 100


def clean(vectors: DataFrame, relabel: Callable[[Column, Column], Column]) -> DataFrame:
    """vec_id, label, vector, dim of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.select(vec_id.alias("vec_id"), label.alias("label"), v.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(usable, F.lit(False))
    )
    once = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("r"))
    return once.select("vec_id", relabel(F.col("vec_id"), F.col("r.label")).alias("label"), F.col("r.vector").alias("vector"), F.size("r.vector").alias("dim"))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x): doubles where all inner products are exact, else Python integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * float(SCALE)) + 0.0
    if not v.size or float(np.abs(v).max()) ** 2 * v.shape[1] < EXACT / 4:
        return v
    out = np.empty(x.shape, dtype=object)
    out[:] = [[int(Fraction(c) * SCALE // 1) for c in row] for row in x.tolist()]
    return out


def _scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, held at the limits of long."""
    if rows.dtype != object and q.dtype != object:
        s = rows @ q
        if not len(s) or np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * max(len(q), 1) < EXACT:
            return s.astype(np.int64)
    every = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in every], dtype=np.int64)


def codebook(half: np.ndarray, words: int) -> np.ndarray:
    """k-means centres; starts from rows spread over the order of their norms."""
    n = len(half)
    order = np.argsort((half * half).sum(axis=1), kind="stable")
    centres = half[order[np.linspace(0, n - 1, min(words, n)).astype(int)]].copy()
    for _ in range(ROUNDS):
        near = nearest_word(half, centres)
        for k in range(len(centres)):
            own = half[near == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return centres


def nearest_word(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(half), dtype=np.int64)
    square = (centres * centres).sum(axis=1)
    for at in range(0, len(half), 16384):
        out[at : at + 16384] = (square - 2 * (half[at : at + 16384] @ centres.T)).argmin(axis=1)
    return out


class Shard:
    """Rows in order of their cells, two codebooks with radii; no index where numbers are too large for one."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        v = whole_numbers(x)
        self.dim, self.cut = x.shape[1], x.shape[1] // 2
        self.indexed = v.dtype != object and self.cut > 0 and len(ids) > 2 * WINDOW
        if not self.indexed:
            self.ids, self.labels, self.v = ids, labels, v
            return
        some = np.argsort((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")[:FIT_ROWS]
        halves = v[:, : self.cut], v[:, self.cut :]
        self.words = [codebook(h[some], CODEWORDS) for h in halves]
        near = [nearest_word(h, w) for h, w in zip(halves, self.words, strict=True)]
        self.radii = []
        for h, w, n in zip(halves, self.words, near, strict=True):
            away = np.sqrt(((h - w[n]) ** 2).sum(axis=1))
            radius = np.zeros(len(w))
            np.maximum.at(radius, n, away)
            self.radii.append(radius)
        cell = near[0] * len(self.words[1]) + near[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(self.words[0]) * len(self.words[1]) + 1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of either half's score for every codeword (a row of ``q`` is an anchor)."""
        out = []
        for part, w, r in zip((q[:, : self.cut], q[:, self.cut :]), self.words, self.radii, strict=True):
            norm = np.sqrt((part * part).sum(axis=1))
            # a little above, as these sums are rounded
            size = norm[:, None] * (np.sqrt((w * w).sum(axis=1)) + r)[None, :]
            out.append(part @ w.T + norm[:, None] * r[None, :] + 1e-9 * size + 0.01)
        return out[0], out[1]

    def cells(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, begin, end) of the cells with rows, in descending order of their bound."""
        a, b = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
        one, two, starts, words = one.tolist(), two.tolist(), self.starts, len(b)
        heap, deep = [(-one[a[0]] - two[b[0]], 0, 0)], [0] * len(a)
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = a[i] * words + b[j]
            if starts[cell] < starts[cell + 1]:
                yield -bound, starts[cell], starts[cell + 1]
            deep[i] = j + 1
            # a cell is pushed when both cells before it have been visited
            if j + 1 < words and (i == 0 or deep[i - 1] > j + 1):
                heapq.heappush(heap, (-one[a[i]] - two[b[j + 1]], i, j + 1))
            if i + 1 < len(a) and deep[i + 1] == j:
                heapq.heappush(heap, (-one[a[i + 1]] - two[b[j]], i + 1, j))

    def windows(self, one: np.ndarray | None, two: np.ndarray | None) -> Iterator[tuple[float, np.ndarray]]:
        """(bound of what comes after, rows) of about ``WINDOW`` rows each."""
        if one is None:
            yield -np.inf, np.arange(len(self.ids))
            return
        held, size = [], 0
        for bound, begin, end in self.cells(one, two):
            if size >= WINDOW:
                yield bound, np.concatenate(held)
                held, size = [], 0
            held.append(np.arange(begin, end))
            size += end - begin
        if held:
            yield -np.inf, np.concatenate(held)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:  # all ties with the k-th stay
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def find_positives(shard: Shard, q: np.ndarray, own: int, label: int, bounds, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k first other rows of the label."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for after, rows in shard.windows(*bounds):
        rows = rows[(shard.labels[rows] == label) & (shard.ids[rows] != own)]
        ids, scores = np.append(ids, shard.ids[rows]), np.append(scores, _scores(shard.v[rows], q))
        best = _best(scores, ids, k)
        ids, scores = ids[best], scores[best]
        if len(ids) == k and scores[-1] > after:
            break
    return ids, scores


def _in_window(scores: np.ndarray, top: int, low: int, high: int) -> np.ndarray:
    """low * top <= high * score <= high * top, without overflow."""
    least = -(-low * top // high)
    return (scores <= top) & (scores >= max(least, -LONG - 1)) if least <= LONG else np.zeros(len(scores), bool)


def find_negatives(
    shard: Shard, q: np.ndarray, label: int, tops: list[int], bounds, k: int, low: int, high: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every top score, (ids, scores) of the k first rows of other labels in its window."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
    open_ = [t for t in range(len(tops)) if low * tops[t] <= high * tops[t]]
    for after, rows in shard.windows(*bounds) if open_ else ():
        rows = rows[shard.labels[rows] != label]
        own, scored = shard.ids[rows], _scores(shard.v[rows], q)
        left = []
        for t in open_:
            fits = _in_window(scored, tops[t], low, high)
            ids, scores = np.append(found[t][0], own[fits]), np.append(found[t][1], scored[fits])
            best = _best(scores, ids, k)
            found[t] = ids[best], scores[best]
            full = len(best) == k and scores[best[-1]] > after
            if not full and not (after == -np.inf or low * tops[t] > high * after):
                left.append(t)
        open_ = left
        if not open_:
            break
    return found


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """shard, dim, ids, labels, vectors: one row per shard and dimension, arrays as bytes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["vector"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
        return pd.DataFrame({
            "shard": [pdf["shard"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
        })

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, ids binary, labels binary, vectors binary")


def blocks_of(anchors: DataFrame, per_block: int, blocks: int) -> DataFrame:
    """dim, ids, labels, vectors, tops: blocks of anchors as bytes; ``tops`` are K scores of each, -1 where there are fewer."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("vec_id")
        for at in range(0, len(pdf), per_block):
            part = pdf.iloc[at : at + per_block]
            tops = np.full((len(part), K), -1, dtype=np.int64)
            for k, own in enumerate(part["tops"]):
                tops[k, : len(own)] = own
            out.append((
                part["dim"].iloc[0], part["vec_id"].to_numpy(np.int64).tobytes(), part["label"].to_numpy(np.int64).tobytes(),
                np.array(part["vector"].tolist(), dtype=np.float64).tobytes(), tops.tobytes(),
            ))
        return pd.DataFrame(out, columns=["dim", "ids", "labels", "vectors", "tops"])

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)))
    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, ids binary, labels binary, vectors binary, tops binary")


def _matrix(row, dim: int) -> np.ndarray:
    return np.frombuffer(row["vectors"]).reshape(-1, dim)


def ask_shards(index: DataFrame, blocks: DataFrame, shards: int, answer: Callable) -> DataFrame:
    """Rows (anchor_id, top, vec_id, score) of ``answer(shard, q, own, label, tops, bounds)`` for
    every shard and anchor. A shard comes first in its task, then the blocks one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                if not row["asked"]:
                    shard, at = Shard(ids, labels, _matrix(row, row["dim"]) if row["dim"] else np.zeros((len(ids), 0))), (row["shard"], row["dim"])
                    continue
                if at != (row["shard"], row["dim"]):
                    continue  # no rows of that dimension in this shard
                x = _matrix(row, row["dim"]) if row["dim"] else np.zeros((len(ids), 0))
                q, tops = whole_numbers(x), np.frombuffer(row["tops"], np.int64).reshape(-1, K)
                bounds = shard.bounds(q) if shard.indexed and q.dtype != object else None
                for k in range(len(ids)):
                    own = (bounds[0][k], bounds[1][k]) if bounds else (None, None)
                    asked = sorted({int(t) for t in tops[k] if t >= 0}, reverse=True)
                    for top, found, scores in answer(shard, q[k], int(ids[k]), int(labels[k]), asked, own):
                        out.append(pd.DataFrame({"anchor_id": ids[k], "top": top, "vec_id": found, "score": scores}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return past_shards(index, blocks, shards, run, "anchor_id long, top long, vec_id long, score long")


def mine(
    spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = K, low: int = LOW, high: int = HIGH,
    relabel: Callable[[Column, Column], Column] = lambda vec_id, label: label, shard_rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; k (at most ``K``) positives each, and
    per positive the k first rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score.
    """
    rows = stored(spark, clean(vectors, relabel), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    row_bytes = 8 * max(facts["dim"] or 0, 1)
    if shard_rows is None:
        cores = spark.sparkContext.defaultParallelism
        shard_rows = max(1, min(SHARD_BYTES // row_bytes, max(LEAST_ROWS, -(-facts["n"] // (2 * cores)))))
    shards = max(1, -(-facts["n"] // shard_rows))
    per_block = block_rows(spark, row_bytes + 8 * (K + 2))
    blocks = max(1, -(-facts["anchors"] // (64 * per_block)))
    index = stored(spark, build_index(rows, shards), "negatives-index")
    anchors = rows.filter(F.col("vec_id") % every == 0)

    def same_label(shard, q, own, label, tops, bounds):
        yield 0, *find_positives(shard, q, own, label, bounds, k)

    def other_labels(shard, q, own, label, tops, bounds):
        for top, found in zip(tops, find_negatives(shard, q, label, tops, bounds, k, low, high), strict=True):
            yield top, *found

    first = blocks_of(anchors.withColumn("tops", F.array().cast("array<long>")), per_block, blocks)
    near = ask_shards(index, stored(spark, first, "anchors"), shards, same_label)
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = near.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k)
    # a window below a negative score is empty
    positives = stored(spark, positives.filter("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    tops = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("tops"))  # at most k
    second = blocks_of(anchors.join(tops, "vec_id"), per_block, blocks)
    hard = ask_shards(index, stored(spark, second, "anchors"), shards, other_labels)
    by_window = Window.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(by_window)).filter(F.col("rank") <= k)
    hard = hard.select("anchor_id", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
