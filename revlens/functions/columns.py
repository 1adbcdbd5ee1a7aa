"""Column-level building blocks (all JVM-side expressions, no Python UDFs).

Numeric convention: money and ratios are computed in exact decimals and rounded
half-up (away from zero) like a SQL ``numeric`` would; a result frame turns the
decimals into doubles only at the edge (see ``revlens.plans.catalog.as_result``).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact count ratios are divided as decimal(20,0) so the quotient keeps 18 decimals.
_COUNT_DECIMAL = "decimal(20,0)"


def pick(values: Sequence, index: Column) -> Column:
    """``values[index]`` for a 0-based integral column (null when out of range)."""
    arr = F.array(*[F.lit(v) for v in values])
    idx = index.cast("int")
    return F.when((idx >= 0) & (idx < len(values)), F.element_at(arr, idx + 1))


def nullif_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def safe_rate(num: Column, den: Column, scale: int = 3) -> Column:
    """``round(num / nullif(den, 0), scale)`` on exact decimals (null when den is 0)."""
    q = num.cast(_COUNT_DECIMAL) / nullif_zero(den).cast(_COUNT_DECIMAL)
    return F.round(q, scale)


def exact_ratio(num: Column, den: Column) -> Column:
    """Unrounded ratio of two exact values, evaluated once in double precision."""
    return num.cast("double") / nullif_zero(den).cast("double")


def exact_avg(value: Column) -> Column:
    """Average over non-null values: exact sum, then one division (order independent)."""
    return F.sum(value).cast("double") / nullif_zero(F.count(value)).cast("double")


def avg_of_doubles(value: Column, scale: int = 10) -> Column:
    """Mean of a double column, rounded to ``scale`` decimals.

    A sum of doubles depends on the (distributed) summation order in its last bits;
    rounding makes the result reproducible. ``+ 0.0`` turns a negative zero positive.
    """
    return F.round(F.avg(value), scale) + F.lit(0.0)


def round_to(value: Column, scale: int) -> Column:
    """Half-up rounding of a double through its shortest decimal form (like ``::numeric``)."""
    return F.round(value.cast("decimal(38,10)"), scale)


def money_sum(value: Column | str) -> Column:
    """Exact sum of a 2-decimal money column, aggregated as long cents.

    A decimal(18,2) sum has a decimal(28,2) buffer, which exceeds 18 digits and makes
    every update allocate; summing integral cents keeps the aggregation buffer a
    primitive long (ANSI mode turns an overflow into an error, never a wrong sum).
    """
    v = F.col(value) if isinstance(value, str) else value
    cents = (v * 100).cast("long")
    return (F.sum(cents).cast("decimal(38,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)")


def month_start(d: Column) -> Column:
    """``date_trunc('month', d)::date``."""
    return F.trunc(F.to_date(d), "MM")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps (microsecond exact, time-zone free)."""
    micros = F.timestamp_diff("MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))
    return micros.cast("double") / F.lit(86400000000.0)


def bucket30(later_month: Column, earlier_month: Column) -> Column:
    """``floor(days between / 30)`` as int: 30-day buckets, not calendar months."""
    return F.floor(F.datediff(later_month, earlier_month) / F.lit(30)).cast("int")


def classify_movement(mrr: Column, prev: Column, nxt: Column, ended: Column) -> Column:
    """Revenue movement of an account-month; the first matching branch wins."""
    return (
        F.when(prev.isNull(), "new")
        .when(mrr > prev, "expansion")
        .when(mrr < prev, "contraction")
        .when((mrr == 0) & (prev > 0), "churned")
        .when(nxt.isNull() & ended.isNotNull(), "churned")
        .otherwise("maintained")
    )


def revenue_change(mrr: Column, prev: Column) -> Column:
    """Unsigned month-over-month change; the whole mrr for a first month."""
    return (
        F.when(prev.isNull(), mrr)
        .when(mrr > prev, mrr - prev)
        .when(mrr < prev, prev - mrr)
        .otherwise(F.lit(0))
    )


def conjunction(predicates: Sequence[Column]) -> Column:
    """AND of predicates; the neutral element is ``true``."""
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


# -- calendar attributes ----------------------------------------------------------------

def day_of_week_sunday0(d: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(d) - 1).cast("int")


def padded_name(d: Column, pattern: str) -> Column:
    """Month/day name blank-padded to 9 characters (``to_char(d, 'Month'|'Day')``)."""
    return F.rpad(F.date_format(d, pattern), 9, " ")
