"""Data-quality operators: each returns the violating rows (0 rows = pass).

Violation frames share one schema ``(model, column, value, rows)`` with the offending
value rendered as text, so rules over different key types can be unioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import conjunction

VIOLATION_COLUMNS = ["model", "column", "value", "rows"]


def _tag(df: DataFrame, model: str, column: str, value, rows) -> DataFrame:
    return df.select(
        F.lit(model).alias("model"), F.lit(column).alias("column"),
        value.cast("string").alias("value"), rows.cast("long").alias("rows"),
    )


def check_unique(df: DataFrame, model: str, columns: str | Sequence[str]) -> DataFrame:
    """Key values (non-null) occurring more than once, with their multiplicity.

    One shuffle on the key with partial counting before it; a hot key collapses to
    one partial count per map task.
    """
    cols = [columns] if isinstance(columns, str) else list(columns)
    keyed = df.where(conjunction([F.col(c).isNotNull() for c in cols]))
    dup = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    value = F.col(cols[0]) if len(cols) == 1 else F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return _tag(dup, model, ",".join(cols), value, F.col("_n"))


def check_not_null(df: DataFrame, model: str, column: str) -> DataFrame:
    """One row with the number of nulls, if any."""
    n = df.agg(F.count_if(F.col(column).isNull()).alias("_n")).where(F.col("_n") > 0)
    return _tag(n, model, column, F.lit(None), F.col("_n"))


def check_accepted(df: DataFrame, model: str, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted set (nulls pass), with their counts."""
    bad = df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return _tag(bad, model, column, F.col(column), F.col("_n"))


def check_relationship(child: DataFrame, model: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child key values without a parent row (null children pass), with row counts.

    The child is counted per key before the join, so a hot key is one row there.
    """
    keys = parent.select(F.col(parent_column).alias("_parent_key"))
    kids = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    orphans = kids.join(keys, kids[column] == keys["_parent_key"], "left_anti")
    return _tag(orphans, model, column, F.col(column), F.col("_n"))
