"""Packing documents into fixed-size token sequences by minimum bin slack.

1. Every document becomes its token ids plus a closing id; documents longer than a
   sequence are cut, the remainder first, then full pieces.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus size)
   is planned by minimum bin slack: each bin is seeded with the longest length left, a
   bitset subset-sum programme over the lengths left finds the fullest completion, and
   the combination is removed as often as the counts allow.
3. Pieces of one length are numbered without a global sort: a running number inside
   each task plus the totals of the tasks before it. The number decides sequence and
   offset, so even a third of all rows having one length stays spread over tasks.

Null and empty texts are one piece holding only the closing id. Repeated rows are
packed as often as they occur; a null ``doc_id`` stays null. An empty table gives an
empty result. A text of any length is encoded whole, one at a time. Only ``doc_id`` and
``text`` are read, other columns do not matter.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import map_slices, stored, text_or_empty

CAPACITY = 2048
CLOSING_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Rank files that hold the same vocabulary as a tokenizer file.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
#: Texts of these characters are encoded from the vocabulary's rank file, which is several
#: times faster; all others, and texts with the strings of special tokens, from the JSON file.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u017f\u2013\u2014\u2018-\u201d\u2026\u20ac]*")
_SPECIAL = "<|"
#: The rank file's library fails on about a million blanks in a row; texts with longer runs
#: than this are encoded from the JSON file as well.
LONGEST_BLANK = 100_000
_BLANKS = re.compile("[\t\n\r ]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, ranks: str | None = None):
        self.path = path
        self.ranked = _ranked(ranks) if ranks else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.ranked and _SPECIAL not in text and _PLAIN.fullmatch(text) and not _long_blanks(text):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()


def _long_blanks(text: str) -> bool:
    if len(text) <= LONGEST_BLANK:
        return False
    return any(m.end() - m.start() > LONGEST_BLANK for m in _BLANKS.finditer(text))


def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _encoder(path: str, ranks: str | None) -> Encoder:
    """One for each worker process."""
    return Encoder(path, ranks)


def cut_pieces(docs: DataFrame, capacity: int, path: str, ranks: str | None, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] task, number: one row per piece.

    ``number`` counts the pieces of the same length in the same task.
    """

    def run(batches):
        encoder = _encoder(path, ranks)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = encoder.encode(text) + closing
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                starts = [0, *range(first, n, capacity)]
                for k, a in enumerate(starts):
                    b = first if k == 0 else a + capacity
                    ids = raw[4 * a : 4 * b]
                    row = (None if pd.isna(doc_id) else int(doc_id), k, a, b - a, zlib.crc32(ids), task, int(seen[b - a]))
                    out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if keep_ids else row)
                    seen[b - a] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", *["ids"] * keep_ids]
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_slices(texts, run, schema + (", ids array<int>" if keep_ids else ""))


def ids_crc32(ids: str) -> Column:
    """CRC of a column's token ids as little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    return crc(ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room`` (longer lengths first)."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            best -= k * length
            taken[length] = taken.get(length, 0) + k
    return taken


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths per bin, number of such bins), covering the histogram exactly."""
    left = {length: n for length, n in histogram.items() if n > 0}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        combo = fullest({k: v for k, v in left.items() if v and k <= capacity - seed}, capacity - seed)
        left[seed] += 1
        combo[seed] = combo.get(seed, 0) + 1
        times = min(left[length] // n for length, n in combo.items())
        for length, n in combo.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        plan.append((combo, times))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first number, first bin, pieces per bin, offset in the bin)."""
    table: dict[int, list] = {}
    used: dict[int, int] = {}
    bins = 0
    for combo, times in plan:
        offset = 0
        for length in sorted(combo, reverse=True):
            n = combo[length]
            table.setdefault(length, []).append((used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        bins += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in table.items()}


def pack(
    spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = True
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; ``keep_ids`` adds the token ids."""
    path, ranks = tokenizer_path(tokenizer), RANKS.get(tokenizer)
    pieces = cut_pieces(docs, capacity, path, tokenizer_path(ranks) if ranks else None, keep_ids)
    pieces = stored(spark, pieces, "pieces")
    per_task = stored(spark, pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan_bins(histogram, capacity))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, numbers = length.to_numpy(np.int64), number.to_numpy(np.int64)
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        borders = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, borders):
            if not len(rows):
                continue
            size = int(lengths[rows[0]])
            slot = table[size]
            hit = slot[np.searchsorted(slot[:, 0], numbers[rows], side="right") - 1]
            inside = numbers[rows] - hit[:, 0]
            sequence[rows] = hit[:, 1] + inside // hit[:, 2]
            offset[rows] = hit[:, 3] + inside % hit[:, 2] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # one row per task and length: it grows with the input, so it is never sent to every task
    placed = pieces.join(base.hint("merge"), ["task", "length"]).withColumn("at", place("length", F.col("base") + F.col("number")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * keep_ids
    )
