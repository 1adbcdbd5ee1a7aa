"""Wide <-> long reshaping: one-pass metric unpivot and the cohort matrix pivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, Column],
                    name: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """Long form ``(ids..., name, value)`` of several metric columns in one scan.

    Replaces a UNION ALL of one aggregate per metric (which scans the source once per
    branch) by a single ``Expand``.
    """
    wide = df.select(*ids, *[c.alias(label) for label, c in metrics.items()])
    return wide.unpivot(list(ids), list(metrics), name, value)


def cohort_pivot(df: DataFrame, row: str, column: str, value: Column, max_column: int = 12) -> DataFrame:
    """Matrix ``row x column`` of ``value`` for columns 0..``max_column``.

    The columns are fixed, so no pass over the data looks for them first. Cells at a
    negative offset, of which there may be any number, are the map ``before`` from offset
    to value, in order of the offset (null where a row has none). Of repeated cells the
    largest value counts.
    """
    kept = df.where(F.col(column) <= max_column).groupBy(row, column).agg(F.max(value).alias("_cell"))
    cells = [F.max(F.when(F.col(column) == k, F.col("_cell"))).alias(str(k)) for k in range(max_column + 1)]
    early = F.sort_array(F.collect_list(F.when(F.col(column) < 0, F.struct(F.col(column), F.col("_cell")))))
    before = F.when(F.size(early) > 0, F.map_from_entries(early))
    return kept.groupBy(row).agg(*cells, before.alias("before"))


def map_text(pairs: Column, scale: int = 1) -> Column:
    """A map of numbers as text ``key:value,key:value`` with ``scale`` decimals, for consumers without maps."""
    entry = lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast(f"decimal(38,{scale})").cast("string"))
    return F.array_join(F.transform(F.map_entries(pairs), entry), ",")


def one_row(spark: SparkSession, *aggregates: DataFrame) -> DataFrame:
    """Side by side columns of several one-row aggregates, as one row (no join).

    Each aggregate becomes one scalar subquery returning a struct of its columns, so it
    is evaluated once; the result row selects the struct fields.
    """
    structs = [agg.select(F.struct(*[F.col(f"`{c}`") for c in agg.columns])).scalar().alias(f"_s{i}")
               for i, agg in enumerate(aggregates)]
    row = spark.range(1).select(*structs)
    return row.select(*[F.col(f"_s{i}.`{c}`").alias(c) for i, agg in enumerate(aggregates) for c in agg.columns])
