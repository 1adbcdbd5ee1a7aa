"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from revlens.session import scratch_dir

#: Bytes of rows that a task and its Python worker exchange at once.
BATCH_BYTES = 4 << 20


def stored(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with a table all executors share, and fixes per-task values (task
    numbers, running ranks) so that a repeated task cannot change them later.
    """
    path = scratch_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, however long the rows are.

    Spark's own bounds are 10,000 rows and 64 MB. The JVM and the worker of every task each hold a
    batch, and keep much of the memory for later steps. A bound that the session has set stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables of ``stored`` frames that nothing reads any more, and their shuffle files."""
    for df in frames:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    free_shuffles(spark)


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row as the struct ``row``, beside columns made from it; ``row.*`` gives it back.
    So no name that is used meanwhile can clash with a column of the row."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def past_shards(
    index: DataFrame, blocks: DataFrame, shards: int, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Every block past every shard: a task gets one shard, whose rows of ``index`` come first (not
    ``asked``), by dimension, then the rows of ``blocks`` one after another, in small frames."""
    every = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asked", F.lit(True))
    both = index.withColumn("asked", F.lit(False)).unionByName(every, allowMissingColumns=True)
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "asked")
    return map_slices(dealt, fn, schema, 64)


def block_rows(spark: SparkSession, row_bytes: int, batch_bytes: int = 32 << 20) -> int:
    """Rows per block, so that an Arrow batch of blocks stays within ``batch_bytes``."""
    batch = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return max(1, batch_bytes // (max(batch, 1) * row_bytes))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver notice which shuffle files no plan needs any more, and have them removed.

    Spark removes them when the driver's garbage collector finds their plan gone, which may
    be long after a large step has been written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_slices(
    df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 512
) -> DataFrame:
    """``mapInPandas`` whose function gets frames of at most ``rows`` rows.

    A batch of texts stays in Arrow's buffers; only a slice of it at a time becomes Python
    strings, which keeps a worker small.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, rows).to_pandas(integer_object_nulls=True) for b in batches for at in range(0, b.num_rows, rows))
        for out in fn(slices):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
