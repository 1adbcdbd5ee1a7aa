"""Duplicate byte strings across documents, by induced sorting of sample suffixes.

A byte goes when some run of ``LENGTH`` bytes that covers it also starts earlier (in a
document with a smaller id, or further left in the same one); runs do not cross
documents and are judged on the input.

Sorting the suffixes of every byte would shuffle more than ten times the input, so the
suffixes are sorted at sample positions, which equal runs pick alike (see
``suffix_samples``), and the order at the positions before them is induced:

1. Sampling: each position's gram hash and the hash of the bytes around it. Equal
   surroundings of one task are folded before the shuffle: all but the first are covered.
2. By gram, positions are read in sorted order: one whose surroundings stand earlier is
   covered as far as they reach; one whose gram stands elsewhere in other surroundings,
   at the edge of a repeat, needs a closer look. Most positions need none.
3. For these the surrounding bytes are fetched. Spark's external sort orders them by the
   bytes from the position on (suffix tuples); the common prefix of neighbours is kept
   beside them. Stable sorting by the byte before induces the order of the suffixes that
   start one byte earlier, and range minima give their common prefixes, again and again
   to the left. Neighbours with a common prefix of ``LENGTH`` are equal runs.
4. Grams met by more than ``HOT_ROWS`` positions are spread by their surroundings, and
   their runs are compared by hash with partial aggregation instead of in one task. A
   sample of the documents foresees most, so that step 2 spreads them too; the positions
   that step 2 leaves of every other gram are counted, and step 3 gets none with more.
5. The spans of each document are merged and its text is cut.

Null texts are empty. Null ids come after all others. Rows that share an id are ordered
by a hash of their text; rows that repeat both are one document and get the same result.
Texts of any length are read in blocks; the kept bytes of one text are one value. Above
``HOT_ROWS`` positions of one gram, runs are equal by a 64-bit hash of their bytes, not by the
bytes. An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import shingles as S
from revlens.llm.common import free_shuffles, map_slices, stored, text_or_empty
from revlens.llm.suffix_samples import sample

LENGTH = 100
GRAM = 32
#: Positions of one gram that a single task may be given to sort.
HOT_ROWS = 200_000
#: One in so many documents is looked at to foresee such grams; this only decides where
#: step 2 reads positions, in a stream. What step 3 holds in memory is counted in full.
LOOK = 32
SLICE = 2048
_NEVER = (1 << 63) - 1


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.withColumn("doc", F.coalesce("doc_id", F.lit(_NEVER))).withColumn("text_key", F.xxhash64("text"))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def hot_grams(rows: DataFrame, hot_rows: int) -> list[int]:
    """Grams that about ``hot_rows`` positions or more share."""
    share = max(hot_rows // LOOK, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams = [sample(_bytes(t), LENGTH, GRAM)[1] for t in pdf["text"]]
            gram, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pd.DataFrame({"gram": gram.view(np.int64), "n": n})

    looked = rows.filter(F.pmod(F.xxhash64("text_key", "doc"), F.lit(LOOK)) == 0).select("text")
    found = map_slices(looked, run, "gram long, n long", SLICE).groupBy("gram").agg(F.sum("n").alias("n"))
    return [r["gram"] for r in found.filter(F.col("n") >= share).collect()]  # a share of the rows each, so few


def sampled(rows: DataFrame, hot: list[int]) -> DataFrame:
    """deal, gram, around, doc, text_key, at, left, right, kind: one row per sample position.

    kind 0: to be compared, 1: of a hot gram, 2: covered already.
    """
    often = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = pdf.sort_values(["doc", "text_key"])
            texts = [_bytes(t) for t in part["text"]]
            made = [sample(t, LENGTH, GRAM) for t in texts]
            counts = [len(m[0]) for m in made]
            place, gram, around = (np.concatenate([m[k] for m in made]) for k in range(3))
            size = np.repeat([len(t) for t in texts], counts)
            out = pd.DataFrame({
                "gram": gram.view(np.int64), "around": around.view(np.int64),
                "doc": np.repeat(part["doc"].to_numpy(), counts), "text_key": np.repeat(part["text_key"].to_numpy(), counts),
                "at": place, "left": np.minimum(place, LENGTH - GRAM).astype(np.int16),
                "right": np.minimum(size - place, LENGTH).astype(np.int16),
            })
            same = out.duplicated(["gram", "around"])  # the first row in document order stays
            twin = out.duplicated(["gram", "around", "doc", "text_key", "at"])
            out = out[~twin]
            same = same[~twin].to_numpy()
            kind = np.where(same, 2, np.isin(out["gram"], often)).astype(np.int8)
            spread = S.mix(out["around"].to_numpy().view(np.uint64) + out["at"].to_numpy().view(np.uint64) * same).view(np.int64)
            yield out.assign(kind=kind, deal=np.where(kind == 0, out["gram"], spread))

    schema = "gram long, around long, doc long, text_key long, at long, left short, right short, kind byte, deal long"
    return map_slices(rows.select("doc", "text_key", "text"), run, schema, SLICE)


def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covered spans (gram null) and positions at the edge of a repeat, from sorted positions.

    Out: doc, text_key, a, b, gram, kind; a position has a = b.
    """
    last = None  # the first position of the surroundings that the previous batch ended in
    pending = None  # the last first position, whose successor is not known yet
    for pdf in batches:
        given, pdf = pdf[pdf["kind"] == 2], pdf[pdf["kind"] != 2]
        out = [_span(given)]
        if len(pdf):
            gram, around, kind = (pdf[c].to_numpy() for c in ("gram", "around", "kind"))
            new = np.append(True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1]))
            where = pdf[["doc", "text_key", "at"]].to_numpy()
            if last is not None and last[0] == gram[0] and last[1] == around[0]:
                new[0] = False
            group = np.cumsum(new) - 1
            begin = where[new]
            if not new[0]:  # group -1 goes on from the batch before
                begin = np.concatenate([[last[2]], begin])
                group = group + 1
            out.append(_span(pdf[~new & (where != begin[group]).any(axis=1)]))
            last = (gram[-1], around[-1], begin[group[-1]])
            firsts = pdf[new].assign(before=False)
            if pending is not None:
                firsts = pd.concat([pending, firsts])
            if len(firsts):
                gram = firsts["gram"].to_numpy()
                alike = gram[1:] == gram[:-1]
                before = firsts["before"].to_numpy().copy()
                before[1:] |= alike
                edge = before[:-1] | alike | (firsts["kind"].to_numpy()[:-1] == 1)
                out.append(_place(firsts.iloc[:-1][edge]))
                pending = firsts.iloc[-1:].assign(before=before[-1])
        yield pd.concat(out)
    if pending is not None:
        yield _place(pending[pending["before"] | (pending["kind"] == 1)])


def _span(p: pd.DataFrame) -> pd.DataFrame:
    a, b = p["at"] - p["left"], p["at"] + p["right"]
    return pd.DataFrame({"doc": p["doc"], "text_key": p["text_key"], "a": a, "b": b, "gram": pd.Series(0, p.index, dtype="int64"), "kind": np.int8(2)})


def _place(p: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc": p["doc"], "text_key": p["text_key"], "a": p["at"], "b": p["at"], "gram": p["gram"], "kind": p["kind"].astype(np.int8)})


def crowded(edges: DataFrame, hot_rows: int) -> list[int]:
    """Grams not foreseen of which more than ``hot_rows`` positions are to be compared."""
    found = edges.filter("kind = 0").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    return [r["gram"] for r in found.collect()]  # more than ``hot_rows`` positions each, so few


def surroundings(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """gram, kind, doc, text_key, at, left, right: the bytes before and from each position."""
    wanted = edges.groupBy("doc", "text_key").agg(F.collect_list(F.struct("a", "gram", "kind")).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, key, text, places in pdf.itertuples(index=False, name=None):
                raw = text.encode()
                for p in places:
                    at = p["a"]
                    out.append((p["gram"], p["kind"], doc, key, at, raw[max(at - LENGTH + GRAM, 0) : at], raw[at : at + LENGTH]))
            yield pd.DataFrame(out, columns=["gram", "kind", "doc", "text_key", "at", "left", "right"])

    texts = rows.select("doc", "text_key", "text").join(wanted, ["doc", "text_key"])
    schema = "gram long, kind byte, doc long, text_key long, at long, left binary, right binary"
    return map_slices(texts.select("doc", "text_key", "text", "places"), run, schema)


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] (both included, low <= high) for every pair."""
    span = high - low + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(low), dtype=values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
    return out


def induce(rights: list[bytes], lefts: list[bytes], rank: np.ndarray) -> np.ndarray:
    """Covered runs: a matrix (tuple, t), true where the run starting t bytes before the
    position also stands at a tuple of smaller rank. ``rights`` come sorted."""
    n, reach = len(rights), LENGTH - GRAM
    long_ = np.array([len(r) for r in rights])
    ahead = np.frombuffer(b"".join(r.ljust(LENGTH, b"\0") for r in rights), dtype=np.uint8).reshape(n, LENGTH)
    behind = np.frombuffer(b"".join(x.rjust(reach, b"\0") for x in lefts), dtype=np.uint8).reshape(n, reach)
    deep = np.array([len(x) for x in lefts])

    differ = ahead[1:] != ahead[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    prefix = np.append(0, np.minimum(common, np.minimum(long_[1:], long_[:-1])))  # with the tuple before
    order = np.arange(n)
    covered = np.zeros((n, reach + 1), dtype=bool)
    for t in range(reach + 1):
        starts = np.flatnonzero(prefix < LENGTH)
        if len(starts) < len(order):
            first = np.minimum.reduceat(rank[order], starts)
            covered[order, t] = rank[order] > np.repeat(first, np.diff(np.append(starts, len(order))))
        if t == reach:
            break
        byte = behind[order, reach - 1 - t]
        moved = np.argsort(byte, kind="stable")
        moved = moved[deep[order[moved]] > t]
        if not len(moved):
            break
        byte = byte[moved]
        longer = np.zeros(len(moved), dtype=prefix.dtype)
        alike = np.flatnonzero(byte[1:] == byte[:-1]) + 1
        longer[alike] = 1 + _range_minimum(prefix, moved[alike - 1] + 1, moved[alike])
        prefix, order = longer, order[moved]
        # a tuple that no other can equal within the steps left need not be carried on
        hope = np.maximum(prefix, np.append(prefix[1:], 0)) + (reach - t - 1) >= LENGTH
        if not hope.all():
            kept = np.flatnonzero(hope)
            if not len(kept):
                break
            prefix = np.append(0, _range_minimum(prefix, kept[:-1] + 1, kept[1:]))
            order = order[kept]
    return covered


def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covered spans from tuples sorted by ``right``; whole groups of equal grams at a time."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        heads = [r[:GRAM] for r in pdf["right"]]
        cut = len(heads) - 1
        while cut and heads[cut - 1] == heads[-1]:
            cut -= 1
        rest = pdf.iloc[cut:]
        if cut:
            yield _covered(pdf.iloc[:cut])
    if rest is not None and len(rest):
        yield _covered(rest)


def _covered(pdf: pd.DataFrame) -> pd.DataFrame:
    if len(pdf) < 2:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "text_key", "a", "b")})
    doc, key, at = (pdf[c].to_numpy() for c in ("doc", "text_key", "at"))
    order = np.lexsort((at, key, doc))
    step = (np.diff(doc[order]) != 0) | (np.diff(key[order]) != 0) | (np.diff(at[order]) != 0)
    rank = np.empty(len(pdf), dtype=np.int64)
    rank[order] = np.append(0, np.cumsum(step))
    hit = induce(pdf["right"].tolist(), pdf["left"].tolist(), rank)
    framed = np.pad(hit, ((0, 0), (1, 1))).astype(np.int8)
    change = np.diff(framed, axis=1)
    row, near = np.nonzero(change == 1)
    _, far = np.nonzero(change == -1)  # row by row, in the same order
    return pd.DataFrame({"doc": doc[row], "text_key": key[row], "a": at[row] - far + 1, "b": at[row] - near + LENGTH})


def resolve_hot(spark: SparkSession, tuples: DataFrame) -> DataFrame:
    """The same spans for hot grams, run by run and without bringing a gram together."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gram, doc, key, at, left, right in pdf.itertuples(index=False, name=None):
                data = np.frombuffer(left + right, dtype=np.uint8)
                starts = np.arange(max(len(data) - LENGTH + 1, 0))
                starts = starts[starts <= len(left)]
                out.append(pd.DataFrame({
                    "gram": gram, "step": len(left) - starts, "run": S.range_hashes(data, starts, starts + LENGTH).view(np.int64),
                    "doc": doc, "text_key": key, "a": at - len(left) + starts,
                }))
            yield pd.concat(out)

    places = tuples.select("gram", "doc", "text_key", "at", "left", "right")
    every = map_slices(places, runs, "gram long, step long, run long, doc long, text_key long, a long", SLICE)
    every = stored(spark, every, "hot-runs")
    place = F.struct("doc", "text_key", "a")
    first = every.groupBy("gram", "step", "run").agg(F.min(place).alias("first"))
    again = every.join(first, ["gram", "step", "run"]).filter(place != F.col("first"))
    return again.select("doc", "text_key", "a", (F.col("a") + LENGTH).alias("b"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicate(spark: SparkSession, docs: DataFrame, hot_rows: int = HOT_ROWS, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]: one row per document.

    ``spans`` are the removed byte ranges (start, end), ``kept`` the bytes left.
    """
    rows = _rows(docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sampled(rows, hot_grams(rows, hot_rows)).repartition(tasks, "deal")
    ordered = dealt.sortWithinPartitions("gram", "around", "doc", "text_key", "at").drop("deal")
    sifted = stored(
        spark, ordered.mapInPandas(sift, "doc long, text_key long, a long, b long, gram long, kind byte"), "repeats"
    )
    free_shuffles(spark)
    edges = sifted.filter("kind != 2")
    if unforeseen := crowded(edges, hot_rows):
        edges = edges.withColumn("kind", F.when(F.col("gram").isin(unforeseen), F.lit(1)).otherwise(F.col("kind")).cast("byte"))
    tuples = stored(spark, surroundings(rows, edges), "suffix-tuples")
    free_shuffles(spark)
    span = "doc long, text_key long, a long, b long"
    sorted_ = tuples.filter("kind = 0").repartition(tasks, "gram").sortWithinPartitions("right")
    found = sorted_.select("doc", "text_key", "at", "left", "right").mapInPandas(resolve, span)
    spans = sifted.filter("kind = 2").select("doc", "text_key", "a", "b").union(found)
    if not tuples.filter("kind = 1").isEmpty():
        spans = spans.union(resolve_hot(spark, tuples.filter("kind = 1")))
    per_doc = spans.groupBy("doc", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, found in pdf.itertuples(index=False, name=None):
                raw = text.encode()
                gone = [] if found is None else merge_spans([(s["a"], s["b"]) for s in found])
                ends = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                row = (
                    None if pd.isna(doc_id) else int(doc_id), len(raw), len(raw) - len(kept), len(gone),
                    hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone],
                )
                out.append((*row, kept) if keep_bytes else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * keep_bytes]
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    joined = rows.join(per_doc, ["doc", "text_key"], "left").select("doc_id", "text", "found")
    return map_slices(joined, cut, schema + ", kept binary" * keep_bytes)
