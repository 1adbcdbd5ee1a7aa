"""URL filter: a blocked Bloom filter of the listed prefixes, then an exact hash join.

A rule is a host and a path prefix; it fits the host itself and all its subdomains, and
the longest fitting rule decides. A url therefore fits only rules among its lookups:
(host or parent domain) x (path prefix as long as some listed path).

* The filter has one block of eight 32-bit words per 256 bits; a key sets one bit in
  each word of one block. Tasks build blocks with ``bit_or`` over the listed keys, and
  the filter's size is bounded by ``MAX_FILTER_BYTES``: a longer list only lets more
  false positives through.
* Lookups that the filter passes go to an exact join on (host, path). Only those rows
  are shuffled; the list itself is sent to tasks only if it is counted to be small.

A url that is null or has no ``://`` has an empty host and path and fits no rule; urls
without a rule are allowed. Repeated pages are judged one by one, null page ids are
kept, an empty table gives an empty result, an empty list allows everything. A url of any
length is read whole; it has a lookup for every label of its host and every listed length.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import stored

MAX_FILTER_BYTES = 32 << 20
BITS_PER_KEY = 16
#: Listed prefixes up to this number are sent to the tasks, more are shuffled.
SENT_RULES = 10_000
_WORDS = 8
#: Odd multipliers that pick the bit in each word (the constants of split-block filters).
_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, in lower case (A-Z), and the path that follows it."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    known = F.coalesce(url, F.lit(""))
    found = known.contains("://")
    part = lambda k: F.when(found, F.regexp_extract(known, pattern, k)).otherwise("")
    return F.translate(part(1), UPPER, LOWER), part(2)


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block_and_masks(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    bits = keys.astype(np.int64).view(np.uint64)
    block = ((bits >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    low = (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    spots = (low[:, None] * np.array(_SALTS, dtype=np.uint32)) >> np.uint32(27)
    return block, np.left_shift(np.uint32(1), spots)


def build_filter(rules: DataFrame, n: int) -> np.ndarray:
    return filter_of(rules.select(_key(F.col("host"), F.col("path")).alias("key")), n)


def in_filter(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys the filter passes: all that were put in, and few others."""
    block, masks = _block_and_masks(keys, len(table))
    return ((table[block] & masks) == masks).all(axis=1)


def filter_of(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of n (or so) ``key`` longs as an array of (blocks, 8) words, at most ``MAX_FILTER_BYTES``."""
    blocks = int(min(max(1, -(-n * BITS_PER_KEY // 256)), MAX_FILTER_BYTES // (4 * _WORDS)))

    def spread(batches):
        for pdf in batches:
            block, masks = _block_and_masks(pdf["key"].to_numpy(), blocks)
            yield pd.DataFrame({"block": block} | {f"w{k}": masks[:, k].astype(np.int64) for k in range(_WORDS)})

    words = [f"w{k}" for k in range(_WORDS)]
    made = (
        keys.select("key").mapInPandas(spread, "block long, " + ", ".join(f"{w} long" for w in words))
        .groupBy("block")
        .agg(*[F.bit_or(w).alias(w) for w in words])
        .toPandas()  # one row per block
    )
    table = np.zeros((blocks, _WORDS), dtype=np.uint32)
    if len(made):
        table[made["block"].to_numpy()] = made[words].to_numpy().astype(np.uint32)
    return table


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every page; ``rules``: host, path, verdict.

    Of rules with one host and path, a block counts more than an allow.
    """
    listed = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    listed = stored(spark, listed, "url-rules")
    n = listed.count()
    lengths = [r["n"] for r in listed.select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]
    table = build_filter(listed, n)

    @F.pandas_udf("array<boolean>")
    def perhaps_listed(keys: pd.Series) -> pd.Series:
        counts = keys.map(len).to_numpy()
        flat = np.concatenate([np.asarray(k, dtype=np.int64) for k in keys]) if counts.sum() else np.zeros(0, np.int64)
        return pd.Series(np.split(in_filter(flat, table), np.cumsum(counts)[:-1]))

    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    prefixes = F.array(*[F.when(F.char_length("path") >= k, F.substring("path", 1, k)) for k in lengths])
    prefixes = F.filter(prefixes.cast("array<string>"), lambda p: p.isNotNull())
    lookups = F.flatten(
        F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"))))
    )
    # numbered before the lookups are unfolded, so that they share their row's number
    looked = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("lookups", lookups).withColumn(
        "passed", perhaps_listed(F.transform("lookups", lambda k: _key(k["h"], k["p"])))
    )
    passed = looked.select(
        "row", "page_id", "url", "host", "path",
        F.explode_outer(F.filter("lookups", lambda k, i: F.col("passed")[i])).alias("k"),
    ).select("row", "page_id", "url", "host", "path", "k.h", "k.p")
    exact = listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "blocks")
    hits = passed.join(F.broadcast(exact) if n <= SENT_RULES else exact.hint("shuffle_hash"), ["h", "p"], "left")
    rule = F.struct((F.char_length("h") + F.char_length("p")).alias("n"), F.concat("h", "p").alias("rule"), "blocks")
    judged = hits.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("page_id", "url", "host", "path")],
        F.max(F.when(F.col("blocks").isNotNull(), rule)).alias("best"),
    )
    return judged.select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"),
    )
