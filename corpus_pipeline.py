"""A corpus pipeline over ``documents``: each stage works on what the one before it kept.

1. language ID: documents without a language that can be told go;
2. exact dedup: of equal texts the one with the largest ``doc_id`` stays;
3. n-gram Jaccard join: of each group of near duplicates one document stays;
4. mixing sources to target weights: each document comes as often as the mix takes it;
5. best-fit packing: token sequences, a row per piece with its token ids.

Stages 1 to 4 return the columns of their input, the last the pieces with their places and ids.
They share the executors and their Python workers, so each bounds the batches that go there by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import exact_dedup, language_id, mixing, near_dup, packing
from revlens.llm.common import bound_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return language_id.keep_identified(spark, docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return exact_dedup.keep_one(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dup.keep_one(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return mixing.repeat(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("ngram_join", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Language ID, MinHash bands and packing cannot be written in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
