"""Raw-table reads (CSV or Parquet, explicit schemas), overwrite sinks, load report."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.sources.schemas import RAW_FILES, RAW_SCHEMAS

log = logging.getLogger(__name__)

# Text layout of timestamps in exported CSV (microseconds kept).
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_DATE_FORMAT = "yyyy-MM-dd"


def text_dates(schema: T.StructType) -> T.StructType:
    """The same schema with date/timestamp fields as text (the raw CSV contract)."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, temporal) else f.dataType, True)
        for f in schema.fields
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV with an explicit schema; malformed rows fail the read."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT)
        .csv(path)
    )


CORRUPT = "_corrupt_record"


def read_dirty_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV of which some lines may be damaged: a line that does not fit the schema is kept whole in
    ``_corrupt_record``, with what could be read of it in the other columns."""
    with_line = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_line)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)  # a line is judged by all its fields, whatever a query needs
        .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT)
        .csv(path)
    )


def raw_path(directory: str, name: str, fmt: str) -> str:
    """Location of raw table ``name`` in an export folder (``accounts.csv``, ``accounts.parquet``, ...)."""
    return f"{directory.rstrip('/')}/{RAW_FILES[name].rsplit('.', 1)[0]}.{fmt}"


def read_raw(spark: SparkSession, directory: str, names: Iterable[str] | None = None, fmt: str = "csv",
             schemas: Mapping[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """Read the raw tables found in ``directory``; a missing file is skipped with a warning."""
    schemas = schemas or RAW_SCHEMAS
    out: dict[str, DataFrame] = {}
    for name in names or RAW_FILES:
        path = raw_path(directory, name, fmt)
        if not exists(spark, path):
            log.warning("%s not found, skipping", path)
            continue
        # Parquet is self-describing (typed columns); staging casts either layout.
        out[name] = read_csv(spark, path, schemas[name]) if fmt == "csv" else spark.read.parquet(current_version(spark, path) or path)
    return out


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Overwrite ``path`` with ``df`` (optionally partitioned).

    With ``partition_by``, the rows are rebalanced on the partition columns: a task holds
    few directory values, so it writes few files, and adaptive execution splits a value
    that is larger than the advisory partition size, whatever the session's settings.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT)
             .option("dateFormat", CSV_DATE_FORMAT))
    w.format(fmt).save(path)


VERSION = "version="


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, store = _folder(spark, path)
    return store.exists(folder)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    folder, store = _folder(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(folder)) if store.exists(folder) else []


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column that a table's folder lists, without its null partition."""
    names = [n.removeprefix(f"{column}=") for n in list_folder(spark, path) if n.startswith(f"{column}=")]
    return [n for n in names if n != "__HIVE_DEFAULT_PARTITION__"]


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest complete version folder of a table, if the table has versions."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    found = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith(VERSION)]
    whole = [p.getName() for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return f"{path}/{max(whole)}" if whole else None


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version of the table at ``path``; returns the version's folder.

    A version counts once its ``_SUCCESS`` file exists, so a failed write changes nothing.
    Names sort by time; older versions stay until ``drop_versions``.
    """
    folder = f"{path}/{VERSION}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_table(df, folder, partition_by)
    return folder


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` versions of a table; returns how many went."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith(VERSION)), key=lambda p: p.getName())
    old = found[: len(found) - keep]
    for p in old:
        store.delete(p, True)
    return len(old)


def observed_report(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """The load report from counts that were observed during the load (one row per table)."""
    rows = [*counts.items(), ("total", sum(counts.values()))]
    return spark.createDataFrame(rows, "`table` string, `rows` long")


def load_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table plus a ``total`` row, computed in one job (rollup over a union)."""
    counts = [df.groupBy().count().select(F.lit(name).alias("table"), F.col("count").alias("rows"))
              for name, df in tables.items()]
    union = counts[0]
    for c in counts[1:]:
        union = union.unionByName(c)
    rolled = union.rollup("table").agg(F.sum("rows").alias("rows"))
    return rolled.select(F.coalesce(F.col("table"), F.lit("total")).alias("table"), F.col("rows").cast("long"))
