"""Similarity join on word n-grams: MinHash bands find candidates, full sets decide.

1. Each text becomes its set of hashed five-word shingles. Texts with equal sets are one
   node (told apart by a 128-bit digest of the set) with a number of copies.
2. A node's minima are cut into bands, of any number; it follows from the recall asked for
   at the threshold. Nodes that share a band hash meet in a bucket.
3. The buckets of one cluster hold much the same nodes, band after band. Every node names the
   largest of its buckets, and a bucket joins the group of the bucket that at least half of
   its nodes name (else it is a group of its own). So a cluster is mostly one group for all
   bands, and as nobody joins a group that has joined another, groups cannot chain up.
4. A group is dealt to blocks of about ``BLOCK_NODES`` nodes and ``BLOCK_SHINGLES`` shingles,
   and each pair of blocks is a unit, so no task ever holds a whole large group. All pairs of
   a group are compared, those of a bucket among them; a pair with several common groups
   belongs to the first of them, so links are counted once.
5. Nodes that are in a unit get their full shingle sets: a blocked Bloom filter of their
   (id, text) keys picks the texts, each task keeps one of its repeated rows, and only the
   sets are shuffled, to an exact join. A unit counts all intersections at once and returns,
   per node, its number of links and the first node of its part of the unit: no pair is
   written out.
6. Connected components by minimum propagation with pointer jumping, a stored table per
   round; tables are deleted once nothing reads them.

A text of fewer than five words is one shingle of all its words. Null, empty and blank
texts have no shingles, link to nothing and are their own class. Texts may be of any
length; the set of one text is one value. Rows without a ``doc_id`` take part, and never
name a class unless no member has an id. Repeated rows are copies; ``keep_one`` treats rows
that repeat both id and text as one document. An empty table gives an empty result. Further
columns are ignored by ``join`` and returned as they were by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import shingles as S
from revlens.llm.common import boxed, discard, map_slices, stored, text_or_empty
from revlens.llm.url_filter import filter_of, in_filter

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 19
#: Shingles compared at once inside a unit.
COLUMNS = 4096


def _describe(text: str, bands: int, rows: int, width: int) -> tuple[int, bytes, np.ndarray]:
    own = np.unique(S.shingle_hashes(S.word_hashes(text), width))
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return len(own), digest, S.band_hashes(S.min_hashes(own, bands * rows), rows) if len(own) else np.zeros(0, np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, text_key, digest, shingles (their number), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_describe(t, bands, rows, width) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64").array, "text_key": pdf["text_key"].array,
                "digest": [m[1] for m in made], "shingles": [m[0] for m in made], "bands": [m[2] for m in made],
            })

    return map_slices(_rows(docs), run, "doc_id long, text_key long, digest binary, shingles long, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def groups_of(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """node, shingles, groups: the groups of every node that shares a bucket with another one."""
    met = nodes.select("node", "shingles", F.explode("bands").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(spark, met.join(sizes, "bucket"), "met")
    homes = met.groupBy("node").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("home"))
    named = met.join(homes, "node").groupBy("bucket", "home").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    joins = named.groupBy("bucket").agg(F.max(F.struct("n", "home")).alias("most"), F.first("size").alias("size"))
    joins = joins.select("bucket", F.when(F.col("most.n") * 2 >= F.col("size"), F.col("most.home")).otherwise(F.col("bucket")).alias("group"))
    groups = met.join(joins, "bucket").groupBy("node").agg(F.sort_array(F.collect_set("group")).alias("groups"), F.first("shingles").alias("shingles"))
    groups = stored(spark, groups, "groups")
    discard(spark, met)
    return groups


def units_of(groups: DataFrame) -> DataFrame:
    """group, low, high, side, node, groups: the pairs of blocks (a unit each) that a node is in.

    In a unit of two blocks only nodes of different sides are compared.
    """
    held = groups.select("node", "shingles", "groups", F.explode("groups").alias("group"))
    sizes = held.groupBy("group").agg(F.count("*").alias("n"), F.sum("shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES))
    sizes = sizes.filter("n > 1").select("group", F.least(blocks, F.col("n")).cast("int").alias("blocks"))
    dealt = held.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node", "group"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "groups",
    )


def compare(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets (sorted, without repeats) are similar, as a square matrix."""
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1  # others are in no intersection
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32 if sizes.max() < 1 << 24 else np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        common += held @ held.T  # whole numbers, exact up to 2 ** 24
    common = common.astype(np.float64)
    return common / (sizes[:, None] + sizes[None, :] - common) >= similarity


def _first_common(one: np.ndarray, two: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """The least group that both nodes of each pair are in."""
    width = max(map(len, groups))
    table = np.full((len(groups), width), np.iinfo(np.int64).max)
    for k, g in enumerate(groups):
        table[k, : len(g)] = g
    out = np.full(len(one), np.iinfo(np.int64).max)
    for at in range(0, len(one), 1 << 18):
        a, b = table[one[at : at + (1 << 18)]], table[two[at : at + (1 << 18)]]
        low = out[at : at + (1 << 18)]
        for k in range(width):  # a pad equals only a pad, which is the largest number
            hit = (b == a[:, k : k + 1]).any(axis=1)
            np.minimum(low, a[:, k], out=low, where=hit)
    return out


def judge_unit(unit: pd.DataFrame, similarity: float) -> pd.DataFrame | None:
    """node, first, links of the nodes of one unit that have a link."""
    unit = unit.sort_values("node")
    if len(unit) < 2:
        return None
    like = compare([np.frombuffer(s, dtype=np.uint64) for s in unit["own"]], similarity)
    np.fill_diagonal(like, False)
    if unit["low"].iloc[0] != unit["high"].iloc[0]:
        side = unit["side"].to_numpy()
        like &= side[:, None] != side[None, :]
    if not like.any():
        return None
    one, two = np.nonzero(like)
    groups = [np.asarray(g, dtype=np.int64) for g in unit["groups"]]
    copies = unit["copies"].to_numpy()[two]
    if max(map(len, groups)) > 1:
        copies = np.where(_first_common(one, two, groups) == unit["group"].iloc[0], copies, 0)
    links = np.bincount(one, weights=copies, minlength=len(unit))
    first = np.arange(len(unit))
    while True:
        low = first.copy()
        np.minimum.at(low, one, first[two])
        low = low[low]
        if (low == first).all():
            break
        first = low
    hit = like.any(axis=1)
    node = unit["node"].to_numpy()
    return pd.DataFrame({"node": node[hit], "first": node[first[hit]], "links": links[hit].astype(np.int64)})


def _by_unit(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by unit; a unit may go on in the next batch."""
    rest, out, rows = [], [], 0

    def judged() -> pd.DataFrame | None:
        unit = pd.concat(rest, ignore_index=True)
        rest.clear()
        return judge_unit(unit, similarity)

    for pdf in batches:
        same = np.ones(len(pdf), dtype=bool)
        for c in ("group", "low", "high"):
            values = pdf[c].to_numpy()
            same[1:] &= values[1:] == values[:-1]
            same[0] &= bool(rest) and rest[-1][c].iloc[-1] == values[0]
        starts = np.flatnonzero(~same)
        for at, end in zip(np.append(0, starts), np.append(starts, len(pdf)), strict=True):
            if at in starts and rest and (found := judged()) is not None:
                out.append(found)
                rows += len(found)
            if end > at:
                rest.append(pdf.iloc[at:end])
        if rows > 5000:
            yield pd.concat(out)
            out, rows = [], 0
    if rest and (found := judged()) is not None:
        out.append(found)
    if out:
        yield pd.concat(out)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) from edges (node, first)."""
    both = edges.select("node", F.col("first").alias("to")).union(edges.select("first", "node")).filter("node != to").distinct()
    both = stored(spark, both, "links")
    labels = stored(spark, both.groupBy("node").agg(F.min("to").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), "label")
        low = stored(spark, low, "labels")
        over = low.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        moved = low.join(over, "low").select("node", F.least("low", "jump").alias("label"), (F.col("label") != F.least("low", "jump")).alias("moved"))
        moved = stored(spark, moved, "labels")
        discard(spark, labels, low)
        labels = moved
        if moved.filter("moved").isEmpty():
            discard(spark, both)
            return labels


def _id_key(doc_id: Column) -> tuple[Column, Column]:
    """Two columns without nulls that tell ids apart."""
    return F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id")


def fetch_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The rows of ``wanted`` (id, no_id, text_key, ...) with ``own``, the shingle set of the text."""
    keyed = F.xxhash64("id", "no_id", "text_key")
    table = filter_of(wanted.select(keyed.alias("key")), wanted.count())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()  # of this task's rows
        for pdf in batches:
            pdf = pdf[in_filter(pdf["key"].to_numpy(), table)]
            keys = list(zip(pdf["id"], pdf["no_id"], pdf["text_key"], strict=True))
            fresh = []
            for k in keys:
                fresh.append(k not in seen)
                seen.add(k)
            pdf = pdf[np.array(fresh, dtype=bool)]
            own = [np.unique(S.shingle_hashes(S.word_hashes(t), width)).tobytes() for t in pdf["text"]]
            yield pdf.drop(columns=["text", "key"]).assign(own=own)

    rows = _rows(docs).select(*_id_key(F.col("doc_id")), "text_key", "text").withColumn("key", keyed)
    found = map_slices(rows, sets, "id long, no_id boolean, text_key long, own binary")
    once = found.groupBy("id", "no_id", "text_key").agg(F.first("own").alias("own"))
    return wanted.join(once, ["id", "no_id", "text_key"])


def join(
    spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WIDTH
) -> DataFrame:
    """doc_id, text_key, class_id, copy_id, n_links, kept: one row per input row.

    ``class_id`` is the least ``doc_id`` of the component, ``copy_id`` that of the texts
    with the same shingles, ``n_links`` the other rows that are similar. One row of each
    component is ``kept``.
    """
    bands = S.bands_for(recall, similarity, ROWS)
    signed = stored(spark, signatures(docs, bands, ROWS, width), "signatures")
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = signed.filter("shingles > 0").groupBy("digest").agg(
        F.min(named).alias("best"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles")
    )
    nodes = stored(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = groups_of(spark, nodes)
    wanted = nodes.join(groups.select("node"), "node", "left_semi").select("node", "copies", *_id_key(F.col("best.doc_id")), "best.text_key")
    wanted = stored(spark, wanted, "wanted")
    full = stored(spark, fetch_sets(spark, docs, wanted, width).select("node", "copies", "own"), "shingle-sets")
    discard(spark, wanted)

    dealt = units_of(groups).join(full, "node")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = ["group", "low", "high"]
    by_unit = dealt.select(*unit, "side", "node", "groups", "copies", "own").repartition(tasks, *unit).sortWithinPartitions(*unit)
    judged = map_slices(by_unit, lambda p: _by_unit(p, similarity), "node long, first long, links long", 1024)
    judged = stored(spark, judged, "judged")
    discard(spark, groups, full)
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(spark, judged.select("node", "first"))

    known = (
        nodes.join(labels, "node", "left")
        .join(links, "node", "left")
        .select("digest", "best", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    known = stored(spark, known, "known")
    discard(spark, nodes, judged, labels)
    heads = known.groupBy("label").agg(F.min("best").alias("head"))
    known = known.join(heads, "label").select("digest", "best", "copies", "links", "head")
    out = signed.select("doc_id", "text_key", "digest").join(known, "digest", "left")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    return out.select(
        "doc_id",
        "text_key",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("copy_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        (F.col("head").isNull() | me.eqNullSafe(F.col("head"))).alias("kept"),
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without the near duplicates of a document that stays; columns as they were."""
    goes = join(spark, docs).filter(~F.col("kept")).select(*_id_key(F.col("doc_id")), "text_key")
    goes = stored(spark, goes.distinct(), "near-duplicates")
    id_, no_id = _id_key(F.col("doc_id").cast("long"))
    rows = boxed(docs, id=id_, no_id=no_id, text_key=F.xxhash64(text_or_empty().cast("string")))
    return rows.join(goes, ["id", "no_id", "text_key"], "left_anti").select("row.*")
