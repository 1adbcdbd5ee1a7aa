"""Date spines: the day calendar and the per-row month expansion.

A range predicate against a calendar (``cross join calendar where month between a and
b``) plans as a nested-loop join. Both operators here are ``Generate`` nodes over
``sequence`` instead: no join, no shuffle, work linear in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.config import Horizon
from revlens.functions.columns import day_of_week_sunday0, padded_name

#: Account-months that a task of ``deal_out`` is to hold, where the horizon knows its accounts.
MONTHS_IN_TASK = 500_000


def _interval(unit: str) -> Column:
    return F.expr(f"INTERVAL 1 {unit}")


def calendar_columns(d: Column) -> list[Column]:
    """The day-calendar attributes of date column ``d`` (dim_date's column order)."""
    return [
        d.alias("date"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.quarter(d).alias("quarter"),
        F.dayofmonth(d).alias("day"),
        day_of_week_sunday0(d).alias("day_of_week"),
        padded_name(d, "MMMM").alias("month_name"),
        padded_name(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.trunc(d, "MM").alias("month_start_date"),
        F.last_day(d).alias("month_end_date"),
        F.trunc(d, "QUARTER").alias("quarter_start_date"),
        F.dayofyear(d).alias("day_of_year"),
    ]


def calendar_from_bounds(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per day between the two date columns of a one-row ``bounds`` frame."""
    days = bounds.select(F.explode(F.sequence(F.col(start), F.col(end), _interval("DAY"))).alias("d"))
    return days.select(*calendar_columns(F.col("d")))


def calendar(spark: SparkSession, horizon: Horizon) -> DataFrame:
    """The day calendar of a fixed horizon (both ends inclusive)."""
    bounds = spark.range(1).select(F.lit(horizon.start).alias("start"), F.lit(horizon.end).alias("end"))
    return calendar_from_bounds(bounds)


def register_series(spark: SparkSession) -> None:
    """SQL table functions ``month_series(lo, hi)`` and ``day_series(lo, hi)`` of the session.

    ``FROM t, LATERAL month_series(t.lo, t.hi) m`` gives a row per first-of-month (or day) from
    ``lo`` to ``hi``, both included, and plans as a generator: no calendar, no join. A
    reversed or null bound gives no rows.
    """
    for name, column, unit in (("month_series", "month", "MONTH"), ("day_series", "day", "DAY")):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(lo DATE, hi DATE) RETURNS TABLE ({column} DATE) "
            f"RETURN SELECT explode(CASE WHEN lo <= hi THEN sequence(lo, hi, INTERVAL 1 {unit}) END)"
        )


def deal_out(df: DataFrame, key: str, horizon: Horizon) -> DataFrame:
    """Rows by ``key`` into a set number of tasks, to be expanded to months there.

    Adaptive execution merges shuffle partitions by the bytes they have before they expand, in a
    union even down to one task that then holds every month of the table. A set number is
    left alone: twice ``spark.sql.shuffle.partitions``, as rows get many times more here than where
    that number suits, or the months a row may become if these are more. Where the horizon knows
    its accounts, there are also enough tasks that none gets more than ``MONTHS_IN_TASK``, so that
    what a task holds does not grow with the table. It is never the number of the session's own
    shuffles: rows that a join or aggregation has dealt by the same key into as many would not be
    dealt again, and those may be merged.
    """
    conf = df.sparkSession.conf
    own = {conf.get("spark.sql.shuffle.partitions"), conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)}
    wanted = -(-horizon.accounts * horizon.months // MONTHS_IN_TASK)
    tasks = max(2 * int(conf.get("spark.sql.shuffle.partitions")), horizon.months, wanted)
    while str(tasks) in own:
        tasks += 1
    return df.repartition(tasks, key)


def month_spine(df: DataFrame, first: Column, last: Column, horizon: Horizon, name: str = "month") -> DataFrame:
    """Expand each row to the first-of-month dates from ``first`` to ``last``.

    ``first``/``last`` are month starts; the result is also clipped to the calendar
    (its first month .. its last day). Rows whose range is empty produce nothing:
    the ``when`` guard keeps ``sequence`` from ever seeing a reversed range. The
    generator is narrow: it runs in the tasks that read or joined the rows.
    """
    lo = F.greatest(first, F.lit(horizon.first_month))
    hi = F.least(last, F.lit(horizon.end))
    months = F.when(lo <= hi, F.sequence(lo, hi, _interval("MONTH")))
    return df.select("*", F.explode(months).alias(name))
