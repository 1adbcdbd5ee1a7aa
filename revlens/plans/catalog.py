"""Registry of the named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the test tables under ``sf_dir`` (through the raw-shape derivation)
and returns a result frame: decimals become doubles at this edge only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.plans.model import Warehouse

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def as_result(df: DataFrame) -> DataFrame:
    """Cast exact decimals to double for the consumer; everything else unchanged."""
    cols = [
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def query(name: str) -> Callable[[Callable[[Warehouse], DataFrame]], Callable[[Warehouse], DataFrame]]:
    """Register ``fn(warehouse) -> DataFrame`` as query ``name`` over the test tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_result(fn(Warehouse.from_testdata(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


def raw_query(name: str) -> Callable[[QueryFn], QueryFn]:
    """Register a query that needs the session and directory itself."""

    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_result(fn(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return register


def all_queries() -> dict[str, QueryFn]:
    import revlens.plans.queries  # noqa: F401  (registers everything)

    return dict(QUERIES)
