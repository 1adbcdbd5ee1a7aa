"""Language-model scores of documents: prediction by partial matching over bytes.

A text is its bytes in UTF-8 with A-Z in lower case, then an end symbol. The model is a
trie of the ``ORDER`` bytes before a symbol (a start symbol stands before the text), with
counts over all training documents. A symbol's probability is that of the longest context
that saw it; every longer context gives way by its escape probability, d / (n + d) for d
distinct symbols in n occurrences, and the symbols of a longer context are excluded from the
shorter ones. Below order 0 the symbols not seen at all are equally likely. So the
probabilities after any context sum to 1, and a score is the log10 probability of the
text. The model is trained before it scores and does not change meanwhile.

How it runs:

1. Documents are cut into shards of at most ``SHARD_BYTES`` (or one document). For every
   shard, the distinct windows (context and symbol, in one long) and the distinct words
   come with their counts in the shard's training documents.
2. Counts are added up over shards. Windows are sorted so that the nearest byte of a context
   comes first, which is the trie in depth-first order; all windows with the same two nearest
   bytes go to one task, which takes them pair by pair: at most 256 ** (ORDER - 1) rows. Orders
   0 and 1 are a table of 256 x 256 counts, which every task gets.
3. Each shard gets the probabilities of its own windows and the counts of those of its
   words that other shards hold as well, and sums them up per document. So no task holds a
   model of the whole corpus, and nothing is sent to all tasks but the 256 x 256 table.

The base score takes words as independent, with one added to each count. Training are all
documents but those whose crc32 of the id as text leaves ``HELD_OUT`` modulo ``FOLDS``; a null
id counts as empty text. Null text counts as empty (one end). Texts may be of any length,
and are read in blocks. Repeated rows are documents of their own. Without training documents
all symbols are equally likely. An empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import discard, free_shuffles, map_slices, stored, text_or_empty

ORDER = 4
SHARD_BYTES = 64 << 20
FOLDS, HELD_OUT = 7, 2
#: Bytes whose windows are made at once.
BLOCK = 2 << 20
#: Symbols that UTF-8 never holds: the start (in contexts only) and the end of a text.
START, END = 0xFE, 0xFF
SYMBOLS = 256  # of a text: all bytes but START, which stands for none


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, text, train, shard. Shards are told apart by the task and their number in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    rows = rows.withColumns({"train": ~held_out(F.col("doc_id")), "shard": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, dtype=np.int64)
            lengths = pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
            for at, n in enumerate(lengths):
                if size and size + n > SHARD_BYTES:
                    shard, size = shard + 1, 0
                numbers[at] = shard
                size += int(n) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers)], names=batch.schema.names)

    return rows.mapInArrow(run, "doc_id long, text string, train boolean, shard long")


def windows_of(texts: list[bytes], order: int = ORDER) -> Iterator[np.ndarray]:
    """Windows of all positions of the texts, in order, in blocks: nearest byte of the
    context first, the symbol last. A text of n bytes has n + 1."""
    start, end = bytes([START]) * order, bytes([END])
    data = np.frombuffer(b"".join([p for t in texts for p in (start, t, end)]), dtype=np.uint8)
    for at in range(order, len(data), BLOCK):
        part = data[at - order : at + BLOCK]
        n = len(part) - order
        key = part[order - 1 : order - 1 + n].astype(np.int64)
        for k in range(2, order + 1):
            key <<= 8
            key |= part[order - k : order - k + n]
        key <<= 8
        key |= part[order:]
        yield key[part[order:] != START]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Seen:
    """Distinct windows and words of a shard with their counts in training documents."""

    def __init__(self):
        self.keys, self.counts, self.words, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter(), [], 0

    def add(self, texts: list[bytes], train: bool) -> None:
        for at, upto in _slices(texts):
            for key in windows_of(texts[at:upto]):
                keys, counts = np.unique(key, return_counts=True)
                self.waiting.append((keys, counts * train))
                self.size += len(keys)
                if self.size > max(2 * len(self.keys), 1 << 20):
                    self._fold()
        for t in texts:
            if train:
                self.words.update(t.split())
            else:
                self.words.update(dict.fromkeys(t.split(), 0))

    def _fold(self) -> None:
        every = np.concatenate([self.keys, *(w[0] for w in self.waiting)])
        count = np.concatenate([self.counts, *(w[1] for w in self.waiting)])
        self.keys, place = np.unique(every, return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, place, count)
        self.waiting, self.size = [], 0

    def rows(self, shard: int) -> Iterator[pd.DataFrame]:
        self._fold()
        for at in range(0, len(self.keys), 1 << 16):
            upto = slice(at, at + (1 << 16))
            yield pd.DataFrame({"shard": shard, "key": pd.array(self.keys[upto], "Int64"), "word": None, "n": self.counts[upto]})
        words = list(self.words.items())
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            yield pd.DataFrame({"shard": shard, "key": pd.array([None] * len(part), "Int64"), "word": [w for w, _ in part], "n": [n for _, n in part]})


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "replace").lower() for t in texts]


def seen(shards: DataFrame) -> DataFrame:
    """shard, key or word, n: what the shards hold. A shard that two tasks read comes twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for pdf in batches:
            for shard, own in pdf.groupby("shard", sort=False):
                if shard != at and held is not None:
                    yield from held.rows(at)
                    held = None
                at, held = shard, held or Seen()
                for train, part in own.groupby("train"):
                    held.add(_bytes(part["text"]), bool(train))
        if held is not None:
            yield from held.rows(at)

    return map_slices(shards.select("text", "train", "shard"), run, "shard long, key long, word binary, n long")


def low_orders(pairs: np.ndarray) -> np.ndarray:
    """Probability of each symbol after each byte by the orders 0 and -1 alone, where the
    symbols that follow the byte (by ``pairs``, 256 x 256 counts) are excluded."""
    c0 = pairs.sum(axis=0)
    followed = pairs > 0
    n = c0.sum() - (followed * c0).sum(axis=1)
    d = (c0 > 0).sum() - followed.sum(axis=1)
    unseen = SYMBOLS - (c0 > 0).sum()
    novel = 1.0 / max(unseen, 1)
    total = np.where(d > 0, n + d, 1)[:, None]
    escape = np.where(d > 0, d, 1)[:, None] / total
    return np.where((c0 > 0)[None, :], c0[None, :] / total, escape * novel)


def ladder(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Probability of each window's symbol after its context.

    ``keys`` are sorted and hold, with their counts, all windows of the contexts that end in
    their two nearest bytes (or, with an order of 1, in the nearest).
    """
    symbol = keys & 255
    nearest = (keys >> (8 * order)) & 255
    # counts of the symbol after the last k bytes, and what is known of these contexts
    count, context, total, kinds = [], [], [], []
    for k in range(1, order + 1):
        if k == 1:
            count.append(pairs[nearest, symbol])
            context.append(nearest)
            total.append(pairs.sum(axis=1)[nearest])
            kinds.append((pairs > 0).sum(axis=1)[nearest])
            continue
        left = keys >> (8 * (order - k + 1))
        one = np.cumsum(np.append(0, left[1:] != left[:-1])) if len(left) else np.zeros(0, np.int64)
        which, place = np.unique((one << 8) | symbol, return_inverse=True)
        held = np.bincount(place, weights=counts, minlength=len(which)).astype(np.int64)
        owner = which >> 8
        n = len(left) and int(one[-1]) + 1
        count.append(held[place])
        context.append(one)
        total.append(np.bincount(owner, weights=held, minlength=n).astype(np.int64)[one])
        kinds.append(np.bincount(owner[held > 0], minlength=n)[one])
    p = low[nearest, symbol]
    for k in range(1, order + 1):
        n, d = total[k - 1], kinds[k - 1]
        if k < order:  # without the symbols that the next longer context has seen
            which, first = np.unique((context[k] << 8) | symbol, return_index=True)
            fits = count[k][first] > 0
            taken = np.bincount(which[fits] >> 8, weights=count[k - 1][first][fits], minlength=int(context[k].max(initial=-1)) + 1)
            n, d = n - taken.astype(np.int64)[context[k]], d - kinds[k]
        some = d > 0
        whole = np.where(some, n + d, 1)
        p = np.where(count[k - 1] > 0, count[k - 1] / whole, np.where(some, d, 1) / whole * p)
    return p


def probabilities(spark: SparkSession, windows: DataFrame, order: int = ORDER) -> DataFrame:
    """key, logp of all windows; ``windows`` are (key, n) with a row per shard."""
    total = stored(spark, windows.groupBy("key").agg(F.sum("n").alias("n")), "lm-windows")
    pairs = np.zeros((256, 256), dtype=np.int64)
    first, symbol = F.shiftright("key", 8 * order), F.col("key").bitwiseAND(255)
    for r in total.groupBy(first.alias("a"), symbol.alias("b")).agg(F.sum("n").alias("n")).collect():  # at most 256 x 256
        pairs[r["a"], r["b"]] = r["n"]
    low = low_orders(pairs)
    shift = 8 * (order - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            keys, counts = np.append(keys, pdf["key"].to_numpy()), np.append(counts, pdf["n"].to_numpy())
            last = np.searchsorted(keys >> shift, keys[-1] >> shift)  # the last pair may go on
            if last >= 1 << 16:
                yield pd.DataFrame({"key": keys[:last], "logp": np.log10(ladder(keys[:last], counts[:last], pairs, low, order))})
                keys, counts = keys[last:], counts[last:]
        if len(keys):
            yield pd.DataFrame({"key": keys, "logp": np.log10(ladder(keys, counts, pairs, low, order))})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = total.withColumn("pair", F.shiftright("key", shift)).repartition(tasks, "pair").sortWithinPartitions("key")
    found = stored(spark, map_slices(dealt.select("key", "n"), run, "key long, logp double", 1 << 16), "lm-probabilities")
    discard(spark, total)
    return found


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    shards = stored(spark, cut(docs), "lm-shards", "zstd")
    held = stored(spark, seen(shards), "lm-seen", "zstd")
    windows = held.filter("key IS NOT NULL").select("shard", "key", "n")
    logp = probabilities(spark, windows)

    # a word's rows, one per shard; those that hold the whole count need nothing more
    words = held.filter("word IS NOT NULL").select("shard", "word", "n")
    same = Window.partitionBy("word")
    words = words.withColumns({"total": F.sum("n").over(same), "k": F.row_number().over(same.orderBy("shard"))})
    words = words.select(
        "shard", F.when(F.col("total") != F.col("n"), F.col("word")).alias("word"), "total",
        (F.col("k") == 1).alias("once"),
    ).filter("word IS NOT NULL OR once")
    words = stored(spark, words, "lm-words")
    free_shuffles(spark)
    facts = words.filter("once").agg(F.sum("total").alias("n"), F.count_if(F.col("total") > 0).alias("v")).first()
    ends = shards.filter("train").count()
    tokens, kinds = (facts["n"] or 0) + ends, (facts["v"] or 0) + (ends > 0)

    own = windows.select("shard", "key").distinct().join(logp, "key")
    table = own.select("shard", "key", F.lit(None).cast("binary").alias("word"), F.col("logp").alias("value")).unionByName(
        words.filter("word IS NOT NULL").select("shard", F.lit(None).cast("long").alias("key"), "word", F.col("total").cast("double").alias("value")).distinct()
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_key = np.asarray(left["key"].is_valid())
        keys = left["key"].filter(pa.array(is_key)).to_numpy()
        value = left["value"].to_numpy()
        order = np.argsort(keys)
        index, by_key = pd.Index(keys[order]), value[is_key][order]
        counts = Counter()
        text, train = right["text"], right["train"].to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(train):
            counts.update(text[int(at)].as_py().encode("utf-8", "replace").lower().split())
        counts.update(dict.fromkeys(left["word"].filter(pa.array(~is_key)).to_pylist(), 0))
        for word, n in zip(left["word"].filter(pa.array(~is_key)).to_pylist(), value[~is_key].tolist(), strict=True):
            counts[word] = int(n)
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        logs: dict[int, float] = {}
        below = np.log10(max(tokens + kinds + 1, 1))

        def log(n: int) -> float:
            if n not in logs:
                logs[n] = float(np.log10(n + 1) - below)
            return logs[n]

        for begin in range(0, len(text), 512):
            texts = _bytes(text.slice(begin, 512).to_pylist())
            for at, upto in _slices(texts):
                sizes = np.array([len(t) + 1 for t in texts[at:upto]])
                sums, done = np.zeros(len(sizes)), 0
                edges = np.append(0, np.cumsum(sizes))
                for key in windows_of(texts[at:upto]):
                    p = by_key[index.get_indexer(key)]
                    a, b = np.searchsorted(edges, [done, done + len(key)], side="right")
                    cuts = np.append(0, edges[a : np.searchsorted(edges, done + len(key))] - done)
                    sums[a - 1 : a - 1 + len(cuts)] += np.add.reduceat(p, cuts)
                    done += len(key)
                out["score"] += sums.tolist()
            for t in texts:
                found = [counts[w] for w in t.split()]
                found.append(ends)
                out["n_tokens"].append(len(found))
                out["n_known"].append(sum(map(bool, found)))
                out["base_score"].append(sum(map(log, found)))
        return pa.table({
            "doc_id": right["doc_id"], "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
        })

    scored = table.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
