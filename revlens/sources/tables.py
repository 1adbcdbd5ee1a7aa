"""Named tables and permanent views over versioned folders.

A build writes a new version of a table into a folder of its own and registers it under a
name of its own (``fct_support__v<version>``), with statistics of the table and its columns.
The public name (``fct_support``) is a permanent view of one version; replacing the view is
the one step that switches readers over. So a build that fails changes nothing, and a
query that is running goes on reading the version that it started with.

A session catalog may be gone with its application. Each version therefore carries its
layout (``_layout.json`` beside its files), from which ``attach`` registers the newest
complete versions again, e.g. in another application on the same folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.sources.files import VERSION, current_version, drop_versions, exists, list_folder

LAYOUT = "_layout.json"


@dataclass(frozen=True)
class Layout:
    """How a table lies in its folder: partition columns, and hash buckets by some columns."""

    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    file, store = _path(spark, path)
    out = store.create(file, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    file, store = _path(spark, path)
    stream = store.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class TableCatalog:
    """The tables of one folder as tables and views of one database of the session catalog."""

    def __init__(self, spark: SparkSession, database: str, folder: str):
        self.spark, self.database, self.folder = spark, database, folder.rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")

    def name(self, table: str) -> str:
        return f"{quoted(self.database)}.{quoted(table)}"

    def publish(self, df: DataFrame, table: str, layout: Layout = Layout(), analyze: bool = True) -> str:
        """Write a version of ``table``, register it with its statistics, switch the name over; returns its folder."""
        stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{table}/{VERSION}{stamp}"
        version = f"{table}__v{stamp.replace('-', '_')}"
        if layout.bucket_by and layout.partition_by:  # one task a partition and bucket, so that it writes one file of it
            bucket = F.pmod(F.hash(*layout.bucket_by), F.lit(layout.buckets))
            df = df.repartition(*layout.partition_by, bucket)
        elif layout.bucket_by:
            df = df.repartition(layout.buckets, *layout.bucket_by)
        elif layout.partition_by:
            df = df.hint("rebalance", *layout.partition_by)
        writer = df.write.format("parquet").option("path", path)
        if layout.partition_by:
            writer = writer.partitionBy(*layout.partition_by)
        if layout.bucket_by:
            writer = writer.bucketBy(layout.buckets, *layout.bucket_by).sortBy(*layout.bucket_by)
        writer.saveAsTable(self.name(version))
        if not exists(self.spark, f"{path}/_SUCCESS"):  # where the session writes no marks of its own
            _write_text(self.spark, f"{path}/_SUCCESS", "")
        _write_text(self.spark, f"{path}/{LAYOUT}", json.dumps({**asdict(layout), "schema": df.schema.jsonValue()}))
        if analyze:
            self.analyze(version)
        self._switch(table, version)
        return path

    def analyze(self, table: str, columns: bool = True) -> None:
        """Size and row count of a table; with ``columns`` also what the optimizer can use of its columns."""
        kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.StringType)
        names = [quoted(f.name) for f in self.spark.table(self.name(table)).schema if isinstance(f.dataType, kinds)]
        what = f"FOR COLUMNS {', '.join(names)}" if columns and names else "NOSCAN"
        self.spark.sql(f"ANALYZE TABLE {self.name(table)} COMPUTE STATISTICS {what}")

    def _switch(self, table: str, version: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(table)} AS SELECT * FROM {self.name(version)}")

    def create_view(self, name: str, text: str) -> None:
        """A permanent view from SQL text, which any session on this catalog can read."""
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(name)} AS {text}")

    def attach(self, names: Sequence[str] | None = None) -> list[str]:
        """Register the newest complete version of every table of the folder (or of ``names``)."""
        found = []
        for table in names or [n for n in list_folder(self.spark, self.folder) if not n.startswith(("_", "."))]:
            path = current_version(self.spark, f"{self.folder}/{table}")
            if path is None or not exists(self.spark, f"{path}/{LAYOUT}"):
                continue
            layout = json.loads(_read_text(self.spark, f"{path}/{LAYOUT}"))
            version = f"{table}__v{path.rpartition(VERSION)[2].replace('-', '_')}"
            columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in T.StructType.fromJson(layout["schema"]))
            listed = lambda key: ", ".join(map(quoted, layout[key]))
            text = f"CREATE TABLE IF NOT EXISTS {self.name(version)} ({columns}) USING parquet"
            if layout["partition_by"]:
                text += f" PARTITIONED BY ({listed('partition_by')})"
            if layout["bucket_by"]:
                text += f" CLUSTERED BY ({listed('bucket_by')}) SORTED BY ({listed('bucket_by')}) INTO {layout['buckets']} BUCKETS"
            self.spark.sql(f"{text} LOCATION '{path}'")
            if layout["partition_by"]:
                self.spark.sql(f"ALTER TABLE {self.name(version)} RECOVER PARTITIONS")
            self.analyze(version, columns=False)
            self._switch(table, version)
            found.append(table)
        return found

    def folder_of(self, table: str) -> str | None:
        """Folder of the newest complete version."""
        return current_version(self.spark, f"{self.folder}/{table}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.name(name))

    def drop_old(self, table: str, keep: int = 1) -> int:
        """Forget and remove all but the newest ``keep`` versions of a table; returns how many went."""
        prefix = f"{table}__v"
        found = sorted(t.name for t in self.spark.catalog.listTables(self.database) if t.name.startswith(prefix))
        for version in found[: max(len(found) - keep, 0)]:
            self.spark.sql(f"DROP TABLE {self.name(version)}")
        return drop_versions(self.spark, f"{self.folder}/{table}", keep)
