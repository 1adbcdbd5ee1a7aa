"""Exact duplicates through an extendible-hash index kept in shared files.

Keys are 64-bit hashes of the whole text; a bucket holds all keys with a common prefix.

* Directory: the bytes per key prefix are counted in one pass. Starting from a single
  bucket, the directory doubles while a bucket is overfull and could still be split; a
  split gives the two halves a local depth of one more. Prefixes have ``DEPTH`` bits, and
  more where the data is so large that its buckets would come near to single prefixes (they
  are counted once more then), but never more than ``MAX_DEPTH``. So planning the directory
  and sending it to tasks is bounded.
* Pages: each task folds equal texts of its own rows into one entry with the list of
  their ids, comparing the texts, before anything is shuffled. A text that makes up a
  third of all rows reaches its owner as one entry for each batch of rows.
* Owners: whole buckets (key ranges) are dealt to owner tasks by bytes, at most one task a
  bucket. A task reads its
  entries in key order, chains entries whose keys collide, and compares their bytes, so
  two texts with one key get different chain numbers. The leaves are written to shared
  files without the texts.
* Totals per (key, chain) come from a partial aggregation over the leaves.

Of equal texts, the row with the largest ``doc_id`` stays. Null text counts as empty.
Null ids come before all others; of rows that repeat the kept id, one stays. A text may be
of any length, and is one value. An empty table gives an empty result. Further columns are
ignored by ``find_duplicates`` and returned as they were by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import boxed, map_slices, stored, text_or_empty

DEPTH, MAX_DEPTH = 16, 22
BUCKET_BYTES = 32 << 20
#: Bytes that an entry counts besides its text.
ENTRY_BYTES = 64
PAGE_ROWS = 4096


def grow_directory(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each prefix, bytes of each bucket) from the bytes per finest prefix.

    ``weights`` has ``2 ** depth`` entries; buckets are numbered in key order.
    """
    finest = len(weights).bit_length() - 1
    depth = 0
    local = np.zeros(1, dtype=np.int64)  # local depth per directory entry
    while True:
        per_entry = weights.reshape(1 << depth, -1).sum(axis=1)
        # entries of one bucket are neighbours: those equal in their first `local` bits
        first = (np.arange(1 << depth) >> (depth - local)) << (depth - local)
        load = np.bincount(first, weights=per_entry, minlength=1 << depth)[first]
        overfull = (load > capacity) & (local < finest)
        if not overfull.any():
            break
        if (overfull & (local == depth)).any():  # no bit left to tell its halves apart: double
            depth += 1
            local, overfull = np.repeat(local, 2), np.repeat(overfull, 2)
        local = local + overfull
    starts = np.unique(first)
    bucket = np.searchsorted(starts, first)
    bucket = np.repeat(bucket, 1 << (finest - depth))
    return bucket, np.bincount(bucket, weights=weights, minlength=len(starts))


def deal_owners(loads: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each bucket: contiguous key ranges of about equal bytes."""
    ends = np.cumsum(loads)
    middle = ends - loads / 2
    return np.minimum((middle * owners / max(ends[-1], 1)).astype(np.int64), owners - 1)


def depth_for(total: float, bucket_bytes: int) -> int:
    """Bits of the prefixes that are counted: about four of them to a bucket."""
    return int(min(max(DEPTH, np.ceil(np.log2(max(total, 1) / bucket_bytes)) + 2), MAX_DEPTH))


def owners_for(total: float, bucket_bytes: int, buckets: int, partitions: int) -> int:
    """Number of owner tasks: by bytes, at least the session's partitions, at most the buckets."""
    return max(1, min(buckets, max(int(np.ceil(total / bucket_bytes)), partitions)))


def _prefix(key, depth: int):
    return F.shiftrightunsigned(key, 64 - depth)


def prefix_bytes(rows: DataFrame, depth: int) -> np.ndarray:
    """Bytes per key prefix."""
    counted = rows.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.sum(F.octet_length("text") + ENTRY_BYTES).alias("bytes"))
    weights = np.zeros(1 << depth)
    found = counted.toPandas()  # at most 2 ** MAX_DEPTH rows of two numbers
    weights[found["prefix"].to_numpy(np.int64)] = found["bytes"].to_numpy(np.float64)
    return weights


def fold_pages(rows: DataFrame, directory: np.ndarray, owner_of: np.ndarray) -> DataFrame:
    """One entry per distinct text of each batch: owner, bucket, key, sha256, ids, page, text."""
    shift = np.uint64(64 - (len(directory).bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            entries: dict[str, list] = {}
            keys = {}
            for doc_id, text, key in zip(pdf["doc_id"], pdf["text"], pdf["key"], strict=True):
                entries.setdefault(text, []).append(None if pd.isna(doc_id) else int(doc_id))
                keys[text] = key
            key = np.array(list(keys.values()), dtype=np.int64)
            bucket = directory[(key.view(np.uint64) >> shift).astype(np.int64)]
            # largest id first, nulls last: the head of the list is the entry's best row
            ids = [sorted(v, key=lambda x: (x is None, -(x or 0))) for v in entries.values()]
            yield pd.DataFrame({
                "owner": owner_of[bucket], "bucket": bucket, "key": key,
                "sha256": [hashlib.sha256(t.encode()).hexdigest() for t in entries],
                "ids": ids, "page": (task << 40) + number + np.arange(len(ids)), "text": list(entries),
            })
            number += len(ids)

    schema = "owner int, bucket int, key long, sha256 string, ids array<long>, page long, text string"
    return map_slices(rows, run, schema, PAGE_ROWS)


def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves of an owner's entries, which come in key order: texts give way to chain numbers.

    Holds the distinct texts of one key at a time (one, but for hash collisions).
    """
    last, links = None, []
    for pdf in batches:
        numbers = []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            if key != last:
                last, links = key, []
            for k, known in enumerate(links):
                if known == text:
                    break
            else:
                k = len(links)
                links.append(text)
            numbers.append(k)
        yield pdf.drop(columns=["owner", "text"]).assign(chain=np.array(numbers, dtype=np.int32))


def find_duplicates(spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    weights = prefix_bytes(rows, DEPTH)
    if (depth := depth_for(weights.sum(), bucket_bytes)) > DEPTH:
        weights = prefix_bytes(rows, depth)
    directory, loads = grow_directory(weights, bucket_bytes)
    owners = owners_for(loads.sum(), bucket_bytes, len(loads), int(spark.conf.get("spark.sql.shuffle.partitions")))
    owner_of = deal_owners(loads, owners).astype(np.int32)

    pages = fold_pages(rows, directory.astype(np.int32), owner_of)
    owned = pages.repartitionById(owners, F.col("owner")).sortWithinPartitions("key")
    leaves = stored(
        spark,
        map_slices(owned, chain, "bucket int, key long, sha256 string, ids array<long>, page long, chain int"),
        "hash-index",
    )
    totals = leaves.groupBy("key", "chain").agg(
        F.sum(F.size("ids")).cast("long").alias("group_size"),
        F.max(F.struct(F.col("ids")[0].alias("id"), "page")).alias("best"),
    )
    members = leaves.join(totals, ["key", "chain"]).select(
        "bucket", "sha256", "group_size", "best", "page", F.posexplode("ids").alias("at", "doc_id")
    )
    return members.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((F.col("page") == F.col("best.page")) & (F.col("at") == 0)).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "bucket",
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without the copies of a document that stays; columns as they were."""
    found = find_duplicates(spark, docs).filter(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    goes = stored(spark, found.select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("key")), "copies")
    # rows that repeat both id and text have one key: one of them stays
    keyed = boxed(docs, key=_row_key(F.col("doc_id").cast("long"), F.sha2(text_or_empty(), 256)))
    once = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).filter("n = 1")
    return once.join(goes, "key", "left_anti").select("row.*")


def _row_key(doc_id: Column, sha256: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), sha256), 256))
