"""Nearest neighbours by sharded, robust-pruned graphs.

* Vectors are dealt to shards by a hash of their id, so a vector that very many rows share is
  spread too. Shards grow with the data, from ``SHARD_ROWS`` rows to what fits
  ``SHARD_BYTES``, as every query is put to every shard: two shards a core, if they fit. Inside a shard equal vectors are one
  node, which keeps the ids that can ever be among the nearest (the k + 1 smallest).
* A shard's graph grows in batches: greedy beam searches through the graph so far
  propose neighbours, robust pruning with a relaxed distance (``ALPHA``) keeps diverse
  ones, and the edges are added in reverse, pruned again where a node has too many.
  Nodes that cannot be reached from the centre become further entry points.
* Graphs are built and walked in single precision. A shard whose vectors differ in size by
  more than ``SPREAD`` has no graph, as beside the largest the others would all look alike;
  its queries are compared with every node, as are queries ``FAR`` larger than the vectors
  of a shard. That takes about the distances that a walk of ``BEAM`` times ``DEGREE`` may.
* The index is a table with one row per shard (vectors, ids, edges), dealt one shard a task.
* Queries go past every shard in blocks, a row per block; a beam search finds nearby
  nodes, whose distances are then computed in double precision from the original
  vectors. The k best of each shard are merged by (distance, id).

Vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without an id. Rows that repeat an id count once, with their least vector. Vectors
are compared with those of equal dimension only. Fewer than k candidates: all of them.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import block_rows, past_shards, stored

SHARD_ROWS = 4096
SHARD_BYTES = 32 << 20
DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.2
#: The largest components of a shard's vectors may differ by this factor in a graph.
SPREAD = 1e10
FAR = 1e3
#: Points inserted, or queries searched, at once.
BATCH = 512


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``ids`` (b, m) to ``q`` (b, d); missing ids (-1) are infinitely far."""
    away = x[ids] - q[:, None, :]
    return np.where(ids < 0, np.inf, np.einsum("bmd,bmd->bm", away, away))


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest nodes found, expanded nodes) for every query, -1 where there are fewer."""
    b = len(q)
    start = np.repeat(entries[None, :], b, axis=0)
    near = _distances(x, start, q)
    order = np.argsort(near, axis=1, kind="stable")[:, :beam]
    ids, dist = np.take_along_axis(start, order, 1), np.take_along_axis(near, order, 1)
    if ids.shape[1] < beam:
        gap = ((0, 0), (0, beam - ids.shape[1]))
        ids, dist = np.pad(ids, gap, constant_values=-1), np.pad(dist, gap, constant_values=np.inf)
    done = ids < 0
    expanded = []
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = open_.argmin(axis=1)
        more = ~done[live, pick]
        live, pick = live[more], pick[more]
        if not len(live):
            break
        done[live, pick] = True
        node = ids[live, pick]
        row = np.full(b, -1, dtype=ids.dtype)
        row[live] = node
        expanded.append(row)
        new = edges[node].copy()
        known = (new[:, :, None] == ids[live][:, None, :]).any(axis=2)
        new[known] = -1
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_dist = np.concatenate([dist[live], _distances(x, new, q[live])], axis=1)
        all_done = np.concatenate([done[live], new < 0], axis=1)
        keep = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_dist, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1) | (ids[live] < 0)
    return ids, np.stack(expanded, axis=1) if expanded else np.full((b, 0), -1, dtype=ids.dtype)


def robust_prune(x: np.ndarray, p: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Diverse near neighbours of the nodes ``p``: a candidate goes when one already kept is
    closer to it, by the factor ``ALPHA``, than the node is."""
    candidates = np.where(candidates == p[:, None], -1, candidates)
    candidates = -np.sort(-candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1  # repeats
    near = _distances(x, candidates, x[p])
    order = np.argsort(near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    alive = candidates >= 0
    width = max(int(alive.sum(axis=1).max(initial=0)), 1)
    candidates, near, alive = candidates[:, :width], near[:, :width], alive[:, :width]
    held = x[candidates]
    out = np.full((len(p), degree), -1, dtype=candidates.dtype)
    rows = np.arange(len(p))
    for k in range(degree):
        if not alive.any():
            break
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        out[some, k] = candidates[rows, pick][some]
        away = held - held[rows, pick][:, None, :]
        apart = np.einsum("bmd,bmd->bm", away, away)
        alive &= ~(some[:, None] & (ALPHA * ALPHA * apart <= near))
        alive[rows[some], pick[some]] = False
    return out


def _add_reverse(x: np.ndarray, edges: np.ndarray, p: np.ndarray, degree: int) -> None:
    source = np.repeat(p, edges.shape[1])
    target = edges[p].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(nodes), BATCH):
        own, begin, n = nodes[at : at + BATCH], first[at : at + BATCH], count[at : at + BATCH]
        # a batch may add any number of edges to one node; they are taken `degree` at a time
        for k in range(0, int(n.max()), degree):
            spot = begin[:, None] + k + np.arange(degree)[None, :]
            fresh = np.where(k + np.arange(degree)[None, :] < n[:, None], source[np.minimum(spot, len(source) - 1)], -1)
            both = np.concatenate([edges[own], fresh], axis=1)
            fits = (both >= 0).sum(axis=1) <= degree
            packed = -np.sort(-both[fits], axis=1)
            packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
            edges[own[fits]] = packed[:, :degree]
            if (~fits).any():
                edges[own[~fits]] = robust_prune(x, own[~fits], both[~fits], degree)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points) over the rows of ``x``, which are all different."""
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int32)
    centre = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = order[order != centre].astype(np.int32)
    entries = np.array([centre], dtype=np.int32)
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        found, expanded = beam_search(x, edges, entries, x[batch], beam)
        edges[batch] = robust_prune(x, batch, np.concatenate([found, expanded], axis=1), degree)
        _add_reverse(x, edges, batch, degree)
        at, size = at + size, min(2 * size, BATCH)
    while True:
        reached = np.zeros(n, dtype=bool)
        front = entries
        reached[front] = True
        while len(front):
            step = np.unique(edges[front])
            front = step[(step >= 0)]
            front = front[~reached[front]]
            reached[front] = True
        if reached.all():
            return edges, entries
        entries = np.append(entries, np.int32(np.flatnonzero(~reached)[0]))


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, dim of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    # a missing or non-finite component makes the test false or null
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & usable)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))


def build_index(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """dim, shard, vectors, ids, owner, edges, entries: one row per shard, arrays as bytes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        every = np.array(pdf["vector"].tolist(), dtype=np.float64) + 0.0  # -0.0 is 0.0
        x, node = np.unique(every, axis=0, return_inverse=True)
        order = np.argsort(node.ravel(), kind="stable")
        node, ids = node.ravel()[order], pdf["vec_id"].to_numpy()[order]
        place = np.arange(len(node)) - np.searchsorted(node, node)
        if _wide(x):
            edges, entries = np.full((len(x), DEGREE), -1, np.int32), np.zeros(1, np.int32)
        else:
            edges, entries = build_graph((x / _scale(x)).astype(np.float32))
        return pd.DataFrame({
            "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "vectors": [x.tobytes()],
            "ids": [ids[place <= k].tobytes()], "owner": [node[place <= k].astype(np.int64).tobytes()],
            "edges": [edges.tobytes()], "entries": [entries.tobytes()],
        })

    # one shard a task: a graph takes far longer than its bytes tell
    return _shard(rows, shards).repartitionById(shards, F.col("shard")).groupBy("shard", "dim").applyInPandas(
        build, "dim int, shard int, vectors binary, ids binary, owner binary, edges binary, entries binary"
    )


def _scale(x: np.ndarray) -> float:
    """What single precision is divided by, so that squares stay finite."""
    return max(np.abs(x).max(initial=0.0), 1e-300)


def _wide(x: np.ndarray) -> bool:
    peak = np.abs(x).max(axis=1)
    with np.errstate(over="ignore"):
        return bool(peak.max() / peak.min() > SPREAD)


class Shard:
    """A shard of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.at = (row["shard"], row["dim"])
        self.x = np.frombuffer(row["vectors"]).reshape(-1, int(row["dim"]))
        self.ids, owner = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owner"], np.int64)
        self.edges = np.frombuffer(row["edges"], np.int32).reshape(len(self.x), -1)
        self.entries = np.frombuffer(row["entries"], np.int32)
        self.scale, self.wide = _scale(self.x), _wide(self.x)
        self.small = (self.x / self.scale).astype(np.float32)
        every = np.arange(len(self.x))
        self.begin, self.end = np.searchsorted(owner, every), np.searchsorted(owner, every, side="right")

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> Iterator[pd.DataFrame]:
        """query_id, vec_id, score: the k nearest of the shard for each query."""
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            with np.errstate(over="ignore"):
                scaled = part / self.scale
            far = self.wide | (np.abs(scaled).max(axis=1) > FAR)
            found = np.empty((len(part), beam), dtype=np.int32)
            if not far.all():
                found[~far], _ = beam_search(self.small, self.edges, self.entries, scaled[~far].astype(np.float32), beam)
            for own, v, near, every in zip(query_ids[at : at + BATCH], part, found, far, strict=True):
                near = np.arange(len(self.x)) if every else near[near >= 0]
                away = self.x[near] - v
                score = np.sqrt((away * away).sum(axis=1))
                n = self.end[near] - self.begin[near]
                hit = np.concatenate([self.ids[self.begin[i] : self.end[i]] for i in near])
                score = np.repeat(score, n)[hit != own]
                hit = hit[hit != own]
                best = np.lexsort((hit, score))[:k]
                yield pd.DataFrame({"query_id": own, "vec_id": hit[best], "score": score[best]})


def query_blocks(asked: DataFrame, per_block: int, blocks: int) -> DataFrame:
    """dim, ids, vectors: blocks of queries as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        parts = [pdf.iloc[at : at + per_block] for at in range(0, len(pdf), per_block)]
        return pd.DataFrame({
            "dim": [p["dim"].iloc[0] for p in parts], "ids": [p["vec_id"].to_numpy(np.int64).tobytes() for p in parts],
            "vectors": [np.array(p["vector"].tolist(), dtype=np.float64).tobytes() for p in parts],
        })

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, ids binary, vectors binary")


def shards_for(rows: int, cores: int, row_bytes: int, least: int = SHARD_ROWS) -> int:
    """Two shards a core, of ``least`` rows at least and ``SHARD_BYTES`` at most."""
    own = max(least, -(-rows // (2 * cores)))
    return max(1, -(-rows // max(1, min(own, SHARD_BYTES // row_bytes))))


def nearest(
    spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int | None = None, beam: int = BEAM
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of the rows whose id is divisible by ``every``."""
    rows = stored(spark, clean(vectors), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    row_bytes = 8 * max(facts["dim"] or 0, 1)
    cores = spark.sparkContext.defaultParallelism
    shards = shards_for(facts["n"], cores, row_bytes) if shard_rows is None else max(1, -(-facts["n"] // shard_rows))
    index = stored(spark, build_index(rows, shards, k), "graph-index")
    per_block = block_rows(spark, row_bytes + 8)
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = stored(spark, query_blocks(asked, per_block, max(1, -(-facts["asked"] // (64 * per_block)))), "query-blocks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if not row["asked"]:
                    shard = Shard(row)
                elif shard is not None and shard.at == (row["shard"], row["dim"]):  # else no rows of that dimension here
                    q = np.frombuffer(row["vectors"]).reshape(-1, int(row["dim"]))
                    out += shard.search(np.frombuffer(row["ids"], np.int64), q, k, beam)
            if out:
                yield pd.concat(out, ignore_index=True)

    found = past_shards(index, blocks, shards, search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
