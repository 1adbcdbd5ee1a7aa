"""Shared prefixes of conversations, counted in adaptive radix trees.

1. A turn's id is 16 bytes: a big-endian 128-bit digest of its role and text, so texts are
   hashed where they are read and never shuffled. A conversation is the list of its ids in
   order of ``turn`` (null first); rows with the same turn come in order of their ids.
2. ``rebuild`` replaces the first ``h`` turns of a conversation by those of its base
   conversation. The ids put one after another are the key of the conversation.
3. Keys are dealt to tasks by range of (key, conversation) and read in order, in slices of
   at most ``SLICE_TURNS`` turns (or one conversation). A slice is one adaptive radix tree:
   inner nodes hold 4, 16, 48 or 256 children and grow as they fill up, bytes that do not
   branch are compressed into a node's path, and only byte depths that end a turn emit
   trie nodes. So memory is bounded whatever the size of the data or of a common prefix.
4. Nodes that may go on in a neighbouring slice are the prefixes of a slice's first and
   last key; all others are complete. These open nodes are merged: a node's values are
   sums over its slices, and what slices share (a child, a text's bytes, a leaf) is
   counted by the first or the last slice that holds it.
5. Conversations that end in an open node may be very many. Their ids come as one piece
   per slice, and the digest is fed piece by piece, in order, with one piece in memory.

Null role or text counts as empty. Rows without a ``conv_id`` belong to no conversation.
Repeated rows are turns of their own. Turns may be of any length; the ids of one
conversation (24 bytes a turn) are one value, held by one task. An empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import map_slices, stored, text_or_empty

WIDTH = 16
SLICE_TURNS = 1 << 16
#: Children that the layouts of an inner node hold.
LAYOUTS = (4, 16, 48, 256)


class Node:
    """An inner node or a leaf: a compressed path, children by their first byte, and the
    conversations that end here."""

    __slots__ = ("path", "layout", "index", "kids", "ends", "sizes", "first", "last")

    def __init__(self, path: bytes):
        self.path = path
        self.layout = LAYOUTS[0]
        self.index = bytearray()
        self.kids: list[Node | None] = []
        self.ends: list[int] | None = None
        self.sizes = None
        self.first = self.last = False  # whether the slice's first or last key ends here

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            return self.kids[self.index[byte] - 1] if self.index[byte] else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add or replace a child; a full node takes the next larger layout."""
        if self.layout <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) == self.layout:
                self._grow()
                return self.put(byte, kid)
            self.index.append(byte)
            self.kids.append(kid)
        elif self.layout == 48:
            if self.index[byte]:
                self.kids[self.index[byte] - 1] = kid
                return
            if len(self.kids) == 48:
                self._grow()
                return self.put(byte, kid)
            self.kids.append(kid)
            self.index[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.layout == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.index):
                index[byte] = at + 1
            self.index = index
        elif self.layout == 48:
            kids: list[Node | None] = [None] * 256
            for byte in range(256):
                if self.index[byte]:
                    kids[byte] = self.kids[self.index[byte] - 1]
            self.index, self.kids = bytearray(), kids
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None]


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix; halving keeps the comparison in C."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def insert(root: Node, key: bytes, sizes, conv_id: int) -> Node:
    """Add a conversation; returns the node that its key ends in. The root's path is empty."""
    node, at = root, 0
    while at < len(key):
        kid = node.child(key[at])
        if kid is None:
            kid = Node(key[at:])
            node.put(key[at], kid)
            node, at = kid, len(key)
            break
        rest = key[at : at + len(kid.path)]
        same = common_length(kid.path, rest)
        if same < len(kid.path):  # the path forks, or the key ends inside it
            fork = Node(kid.path[:same])
            kid.path = kid.path[same:]
            fork.put(kid.path[0], kid)
            node.put(key[at], fork)
            kid = fork
        node, at = kid, at + same
    if node.ends is None:
        node.ends, node.sizes = [], sizes
    node.ends.append(conv_id)
    return node


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _prefix_ids(key: bytes) -> list[bytes]:
    """Digest of the first d turns, for every d."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.copy().digest())
    return out


NO_ENDS = hashlib.sha256(b"").hexdigest()
ROWS = (
    "open boolean, node binary, parent binary, slice long, depth long, on_first boolean, on_last boolean, last_end boolean, "
    "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, "
    "ends_sha256 string, ends string"
)
FIELDS = [c.split()[0] for c in ROWS.split(", ")]


def slice_nodes(rows: list[tuple[bytes, list[int], int]], number: int) -> list[tuple]:
    """The trie nodes of one slice of (key, bytes of the texts, conversation) rows, in key order.

    Complete nodes have their final values. Of an open node the values are those of this
    slice, without what other slices may count: its child and bytes on the path to the
    first key, and the leaf that the last key may be.
    """
    root = Node(b"")
    ended = [insert(root, key, sizes, conv_id) for key, sizes, conv_id in rows]
    ended[0].first = ended[-1].last = True
    ids = {True: _prefix_ids(rows[0][0]), False: _prefix_ids(rows[-1][0])}
    out: list[tuple] = []

    def emit(depth: int, held: dict, tops: list, ends: list[int] | None) -> tuple[dict, list]:
        """A trie node over what is ``held`` below it; ``tops`` are the nodes that it is the parent of."""
        first, last = held["first"], held["last"]
        size = held["sizes"][depth - 1] if depth else 0
        opened = first or last
        children, leaves = held["children"], held["leaves"]
        last_end = last and not held["below"]
        if not held["below"] and not last:
            leaves = 1
        saved = held["saved"] + held["n"] * size - (0 if first else size)
        me = ids[first][depth] if opened else None
        for top in tops:
            if not top[0]:
                top[9 if not opened else 2] = held["least"] if not opened else me
        ids_text = ",".join(map(str, sorted(ends))) if ends and opened else None
        row = [
            opened, me, ids[first][depth - 1] if opened and depth else None, number, depth, first, last, last_end,
            held["least"], None, held["n"], children, leaves, saved, size,
            None if opened else _sha(sorted(ends)) if ends else NO_ENDS, ids_text,
        ]
        out.append(row)
        up = held | {"children": 0 if first else 1, "leaves": leaves, "saved": saved, "below": True}
        return up, [row]

    # post-order: a frame holds a node, the byte depth where its path starts, its children's results
    stack: list[tuple[Node, int, Iterator[Node], list]] = [(root, 0, iter(root.children()), [])]
    result = None
    while stack:
        node, start, kids, done = stack[-1]
        if result is not None:
            done.append(result)
            result = None
        kid = next(kids, None)
        if kid is not None:
            stack.append((kid, start + len(node.path), iter(kid.children()), []))
            continue
        stack.pop()
        held = {
            "n": sum(h["n"] for h, _ in done), "children": sum(h["children"] for h, _ in done),
            "leaves": sum(h["leaves"] for h, _ in done), "saved": sum(h["saved"] for h, _ in done), "below": bool(done),
            "first": node.first or any(h["first"] for h, _ in done), "last": node.last or any(h["last"] for h, _ in done),
            "sizes": node.sizes if node.ends is not None else done[0][0]["sizes"],
            "least": min([*(node.ends or ()), *(h["least"] for h, _ in done)]),
        }
        held["n"] += len(node.ends or ())
        tops = [t for _, own in done for t in own]
        end = start + len(node.path)
        ends = node.ends
        # turn-aligned depths of the path, deepest first; the root itself is depth 0
        for depth in range(end // WIDTH, (start // WIDTH if node is not root else -1), -1):
            held, tops = emit(depth, held, tops, ends if depth * WIDTH == end else None)
        result = (held, tops)
    return [tuple(r) for r in out]


def _sliced(batches: Iterator[pd.DataFrame], slice_turns: int) -> Iterator[pd.DataFrame]:
    base, number, rows, turns = TaskContext.get().partitionId() << 32, 0, [], 0

    def made() -> pd.DataFrame:
        found = pd.DataFrame(slice_nodes(rows, base + number), columns=FIELDS)
        return found.astype({"parent_conv_id": "Int64"})

    for pdf in batches:
        for key, sizes, conv_id in zip(pdf["key"], pdf["sizes"], pdf["conv_id"], strict=True):
            if rows and turns + len(sizes) + 1 > slice_turns:
                yield made()
                number, rows, turns = number + 1, [], 0
            rows.append((bytes(key), sizes, int(conv_id)))
            turns += len(sizes) + 1
    if rows:
        yield made()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the ids (32 hex digits) and text bytes of a conversation's turns, in order."""
    role, text = text_or_empty("role").cast("string"), text_or_empty("text").cast("string")
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.substring(told, 1, 2 * WIDTH).alias("id"), F.octet_length(text).alias("bytes")).alias("one"),
    ).filter(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuild(spark: SparkSession, told: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> DataFrame:
    """conv_id, key, sizes: the first ``head(c)`` (at most ``most``) turns of conversation
    ``base(c)``, then the own turns after as many."""
    told = stored(spark, told, "conversations")
    c = F.col("conv_id")
    heads = told.filter(base(c) == c).select(c.alias("base"), F.slice("turns", 1, most).alias("lead"))
    both = told.withColumns({"base": base(c), "h": head(c)}).join(heads, "base", "left")
    # a base conversation starts with its own first turns: it stays as it is
    lead = F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    turns = F.concat(lead, F.filter("turns", lambda _, at: at >= F.col("h")))
    both = both.select("conv_id", turns.alias("turns"))
    return both.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["bytes"].cast("int")).alias("sizes"),
    )


def trie(spark: SparkSession, rebuilt: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256:
    one row per distinct prefix of the keys."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rebuilt = stored(spark, rebuilt, "rebuilt")
    ordered = rebuilt.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = map_slices(ordered.select("key", "sizes", "conv_id"), lambda p: _sliced(p, slice_turns), ROWS, 4096)
    found = stored(spark, found, "trie-slices")
    merged = stored(spark, _merge(spark, found.filter("open"), tasks), "trie-open")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    complete = found.filter("NOT open")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    below = complete.filter("parent IS NOT NULL").drop("node").unionByName(
        merged.withColumns({c: F.lit(None) for c in FIELDS if c not in merged.columns}).drop("node"), allowMissingColumns=True
    )
    joined = below.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    return complete.filter("parent IS NULL").select(*names).unionByName(joined.select(*names))


def _merge(spark: SparkSession, opened: DataFrame, tasks: int) -> DataFrame:
    """One row per open node from its rows in all slices."""
    spans = opened.groupBy("node").agg(F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice"))
    rows = opened.drop("ends").join(spans, "node")
    rows = rows.withColumn("owned", (F.col("on_first") & (F.col("slice") == F.col("first_slice"))).cast("int"))
    path = Window.partitionBy("slice", "on_first").orderBy(F.desc("depth"))
    rows = rows.select(
        "*",
        F.sum(F.col("owned") * F.col("bytes")).over(path.rowsBetween(Window.unboundedPreceding, 0)).alias("own_bytes"),
        F.lag("owned", 1, 0).over(path).alias("own_child"),
        F.max((F.col("last_end") & (F.col("slice") == F.col("last_slice"))).cast("int")).over(Window.partitionBy("slice")).alias("leaf"),
    )
    on_first = F.col("on_first")
    sums = rows.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") + F.when(on_first, F.col("own_child")).otherwise(0)).alias("n_children"),
        F.sum(F.col("n_leaves") + F.when(F.col("on_last"), F.col("leaf")).otherwise(0)).alias("n_leaves"),
        F.sum(F.col("saved") - F.when(on_first, F.col("own_bytes")).otherwise(0)).alias("saved"),
    )
    pieces = opened.filter("ends IS NOT NULL").select("node", "slice", "ends")
    pieces = pieces.repartition(tasks, "node").sortWithinPartitions("node", "slice")
    hashes = pieces.mapInArrow(_hash_pieces, "node binary, ends_sha256 string")
    return sums.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each node, which come in order, one at a time."""
    last, h, nodes, hashes = None, None, [], []
    for batch in batches:
        for at in range(batch.num_rows):
            node, piece = batch["node"][at].as_py(), batch["ends"][at].as_py().encode()
            if node == last:
                h.update(b"," + piece)
                continue
            if last is not None:
                nodes.append(last)
                hashes.append(h.hexdigest())
            last, h = node, hashlib.sha256(piece)
        if len(nodes) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
            nodes, hashes = [], []
    if last is not None:
        nodes.append(last)
        hashes.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])


HEADS = 9


def shared_prefixes(spark: SparkSession, conversations: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """``trie`` of the conversations, each rebuilt on the one whose id is the multiple of five
    at or below its own (towards 0), with a head of crc32(id as text) % ``HEADS`` turns."""
    rebuilt = rebuild(
        spark, sequences(conversations), lambda c: c - c % 5, lambda c: (F.crc32(c.cast("string")) % HEADS).cast("int"), HEADS - 1
    )
    return trie(spark, rebuilt, slice_turns)
