"""Session helpers: a tuned local/test session and shared scratch locations.

On a cluster the session comes from the caller; only ``scratch_dir`` is used there,
and it always resolves below ``spark.checkpoint.dir`` (a shared filesystem the cluster
names), never below a machine-local temporary folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: list[str] = []  # scratch folders handed out, for remove_scratch


def _default_driver_memory() -> str:
    """60 % of physical memory, at most 8 GiB (local mode: the driver runs every task)."""
    try:
        with open("/proc/meminfo") as f:
            kib = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        return f"{max(1, min(8192, int(kib * 0.6 / 1024)))}m"
    except (OSError, StopIteration, ValueError):
        return "4g"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "revlens") -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Few bytes may be many rows (a subscription becomes one row per month): do not
        # merge shuffle partitions up to the default of 1 MB before they expand.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REVLENS_DRIVER_MEMORY") or _default_driver_memory())
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Python call-site capture for error context costs several JVM round trips per
        # Column call while plans are built; batch jobs do not need it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Keep compiled whole-stage code of many distinct plans (the default 100 entries
        # is exhausted by one pass over the marts, forcing recompilation).
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Remove checkpoint files of garbage-collected references.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a local one only when unset.

    A cluster configures ``spark.checkpoint.dir`` to a shared folder; that value is
    always respected. Only a ``local[...]`` session, whose tasks share the driver's disk,
    gets a private temporary folder; on any other master an unset folder is an error.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="revlens-ckpt-")
        try:
            spark.conf.set(_CHECKPOINT_KEY, current)
        except Exception:  # noqa: BLE001  (core conf may be read-only at runtime)
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/revlens-scratch/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process has made; frames that read them end with it."""
    jvm, n = spark.sparkContext._jvm, 0
    while _made:
        folder = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
    return n
