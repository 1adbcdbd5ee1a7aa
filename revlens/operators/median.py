"""Exact (interpolated) median per key, ``percentile_cont(0.5)`` semantics.

The values are first counted per (key, value), so duplicates (also of a hot key) fold
before the shuffle.

* Keys with up to ``IN_TASK`` distinct values: running counts over the key's values, in
  one window.
* Other keys: a value is mapped to a long that orders like it, which is split into four
  16-bit digits. Running counts over the at most 65,536 digits that follow the digits
  chosen so far find those of the middle positions; only their values go on to the next
  digit. After the last one a cell holds a single value, so no distribution of the values
  can bring more rows together.

Nulls are ignored; a key without values yields no row (callers left-join -> null). A
null key keeps its median.

That is how a build computes it: it passes ``written``, which stores a frame and reads it
back, and the histogram and the rounds are written. Without it the result is a plan only,
and nothing runs when the function is called: per key, two approximate quantiles whose rank
error is known enclose the median; what lies outside them is folded into one count for
either side, and running counts see the values between them, about one in a thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import conjunction

IN_TASK = 100_000
#: Of the approximate quantiles: their rank is off by at most 1 / ACCURACY of all ranks.
ACCURACY = 10_000
DIGITS = 4
DIGIT_BITS = 16
_UPTO_ROW = (Window.unboundedPreceding, Window.currentRow)


Written = Callable[[DataFrame, str], DataFrame]


def _join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join with null-safe key equality; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = conjunction([left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _middle(lo_rank: Column, count: Column, total: Column) -> Column:
    """Whether ranks ``lo_rank .. lo_rank + count - 1`` (from 0) hold a middle position."""
    return (lo_rank <= F.floor(total / 2)) & (lo_rank + count > F.floor((total - 1) / 2))


def ordered_bits(v: Column) -> Column:
    """A long that orders like the double ``v``: its exponent and fraction, by arithmetic
    that is exact, as only powers of two are divided by."""
    size, least_normal, least = F.abs(v), F.lit(2.0**-1022), F.lit(2.0**-1074)
    near = F.floor(F.log2(size)).cast("int")  # may be one off beside a power of two
    power = F.pow(F.lit(2.0), near)
    exponent = near + F.when(size < power, -1).when(size / power >= 2, 1).otherwise(0)
    fraction = size / F.pow(F.lit(2.0), exponent) - 1
    normal = (exponent + 1023).cast("long") * (1 << 52) + (fraction * float(1 << 52)).cast("long")
    bits = (
        F.when(size < least_normal, (size / least).cast("long"))
        .when(F.isnan(v), F.lit((1 << 63) - 1))  # after all others, as in a sort
        .when(size == float("inf"), F.lit(2047 << 52))
        .otherwise(normal)
    )
    return F.when(v < 0, -bits).otherwise(bits)


def _by_digits(hist: DataFrame, keys: list[str], written: Written) -> DataFrame:
    """The middle values (one or two rows per key) of a histogram with ``_n`` per key."""
    digits = [f"_d{i}" for i in range(DIGITS)]
    mask = (1 << DIGIT_BITS) - 1
    bits = F.col("_bits")
    # the first digit keeps its sign, the others are unsigned
    parts = [F.shiftright(bits, DIGIT_BITS * (DIGITS - 1 - i)) for i in range(DIGITS)]
    parts = [parts[0], *[p.bitwiseAND(F.lit(mask).cast("long")) for p in parts[1:]]]
    cand = hist.withColumn("_bits", ordered_bits(F.col("_v"))).select(
        *keys, "_v", "_c", "_n", F.lit(0).cast("long").alias("_before"), *[p.cast("int").alias(d) for p, d in zip(parts, digits)]
    )
    for i, digit in enumerate(digits):
        chosen = [*keys, *digits[:i]]
        cells = cand.groupBy(*chosen, digit).agg(F.sum("_c").alias("_cc"), F.max("_before").alias("_b"), F.max("_n").alias("_t"))
        upto = F.sum("_cc").over(Window.partitionBy(*chosen).orderBy(digit).rowsBetween(*_UPTO_ROW))
        ranked = cells.withColumn("_rank", F.col("_b") + upto - F.col("_cc"))
        targets = ranked.where(_middle(F.col("_rank"), F.col("_cc"), F.col("_t"))).select(*chosen, digit, "_rank")
        cand = _join_on_keys(cand, targets, [*chosen, digit]).withColumn("_before", F.col("_rank")).drop("_rank")
        cand = written(cand, "median-digits")
    return cand.select(*keys, "_v")


def _by_quantiles(values: DataFrame, keys: list[str]) -> DataFrame:
    """The middle values (one or two rows per key), as a plan."""
    share = [0.5 - 5 / ACCURACY, 0.5 + 5 / ACCURACY]  # each is off by 1 / ACCURACY of the ranks at most
    bounds = values.groupBy(*keys).agg(F.percentile_approx("_v", share, ACCURACY).alias("_bounds"))
    v, low, high = F.col("_v"), F.col("_bounds")[0], F.col("_bounds")[1]
    side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
    folded = _join_on_keys(values, bounds, keys).select(*keys, side.alias("_side"), F.when(side == 0, v).alias("_v"))
    cells = folded.groupBy(*keys, "_side", "_v").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*keys)
    rank = F.sum("_c").over(own.orderBy("_side", "_v").rowsBetween(*_UPTO_ROW)) - F.col("_c")
    ranked = cells.withColumn("_n", F.sum("_c").over(own)).withColumn("_rank", rank)
    middle = ranked.where(_middle(F.col("_rank"), F.col("_c"), F.col("_n")))
    inside = F.when(F.col("_side") == 0, F.col("_v")).otherwise(F.raise_error(F.lit("a median outside its quantiles")).cast("double"))
    return middle.select(*keys, inside.alias("_v"))


def _by_histogram(values: DataFrame, keys: list[str], in_task: int, written: Written) -> DataFrame:
    """The middle values (one or two rows per key), from a stored histogram."""
    hist = written(values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "median-histogram")
    sizes = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"), F.sum("_c").alias("_n"))
    large = sizes.where(F.col("_values") > in_task).drop("_values")
    any_large = not large.isEmpty()

    own = Window.partitionBy(*keys)
    rank = F.sum("_c").over(own.orderBy("_v").rowsBetween(*_UPTO_ROW)) - F.col("_c")
    small = _join_on_keys(hist, large.select(*keys), keys, "left_anti") if any_large else hist
    ranked = small.withColumn("_n", F.sum("_c").over(own)).withColumn("_rank", rank)
    middle = ranked.where(_middle(F.col("_rank"), F.col("_c"), F.col("_n"))).select(*keys, "_v")
    return middle.union(_by_digits(_join_on_keys(hist, large, keys), keys, written)) if any_large else middle


def exact_median(df: DataFrame, keys: Sequence[str], value: Column | str, alias: str = "median",
                 in_task: int = IN_TASK, written: Written | None = None) -> DataFrame:
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    # + 0.0 makes a negative zero the same value as zero
    values = df.select(*keys, (v.cast("double") + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull())
    middle = _by_histogram(values, keys, in_task, written) if written else _by_quantiles(values, keys)
    pair = middle.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return pair.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(0.5)).alias(alias))
