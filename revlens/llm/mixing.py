"""Mixing sources to target weights by repeating documents.

Per source the words are aggregated, the target is derived, and rate = target / words.
Every document is taken floor(rate) times, and once more when a hash-seeded draw falls
below the fraction of the rate. The draw of a document depends only on its ``doc_id``
and the seed, so reruns agree and the order of rows does not matter.

Targets: sources sorted by code point (null last) weigh 3, 1, 2, 3, ... and share
``budget`` times all words; a target stops at ``max_rate`` times the words its source
has, and what is cut off is shared among the others by weight, until none is above.

A few long documents can carry a source far from its target under any single seed, so
``SEEDS`` seeds are summed in the same aggregation and each source uses the one that
comes nearest (ties: the smallest).

Null texts have no words. Null sources form one source of their own. Rows that repeat a
``doc_id`` share its draw, as do rows without one (told apart by their text). An empty
table gives an empty result; sources without words get target 0 and nothing is taken. Texts of
any length are counted whole, in one expression. Further columns are ignored by ``mix`` and
returned as they were by ``repeat``, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import stored, text_or_empty

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_RATE = 2.0
SEEDS = 32
#: A plan of up to so many sources is sent to the tasks, a longer one is shuffled.
SENT_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
_DRAWS = 1 << 32


def words() -> Column:
    """Number of words: each becomes one letter and the blanks go, so no list of a text's words is made."""
    marks = F.regexp_replace(text_or_empty(), WORD, "w")
    return F.length(F.translate(marks, BLANKS, "")).cast("long")


def draw_numbers() -> tuple[Column, Column]:
    """The two hash numbers of a document that all its draws are made from."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), text_or_empty())))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def draw(first: Column, stride: Column, seed: Column) -> Column:
    """Uniform in [0, 1)."""
    return ((first + seed * stride) % _DRAWS) / F.lit(float(_DRAWS))


def copies(first: Column, stride: Column) -> Column:
    """How often a document joined with its source's plan is taken."""
    return (F.col("whole") + F.when(draw(first, stride, F.col("seed")) < F.col("fraction"), 1).otherwise(0)).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, first, stride of every document."""
    first, stride = draw_numbers()
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), words().alias("size"), first.alias("first"), stride.alias("stride")
    )


def weighed(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """source, source_size, weight: the weights repeat in order of the sources, however many.

    Sources are sorted by ranges, a task each; a source's place is that in its range after
    the rows of the ranges before it (one count per task comes to the driver).
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranged = totals.repartitionByRange(tasks, order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id())
    ranged = stored(spark, ranged, "mix-sources").withColumn("range", F.shiftright("place", 33).cast("int"))
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for number, n in counts:
        starts.append((number, before))
        before += n
    # a row per task at most; from Arrow it is a local relation, from a list Python workers would make it
    starts = pa.table({"range": pa.array([s[0] for s in starts], pa.int32()), "start": pa.array([s[1] for s in starts], pa.int64())})
    starts = F.broadcast(spark.createDataFrame(starts))
    at = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (at % len(WEIGHTS) + 1).cast("int"))
    return ranged.join(starts, "range").select("source", "source_size", weight.alias("weight"))


def targets(spark: SparkSession, totals: DataFrame, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """source, source_size, target: one row per source.

    Round by round, the sources whose share at the common rate is above their limit are shut,
    and the others share what is left, until none is above; a round is one plain aggregate.
    """
    rows = stored(spark, weighed(spark, totals), "mix-weights")
    limit = max_rate * F.col("source_size")
    first = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"), F.count("*").alias("n")).first()
    everything, rate, n_open = budget * (first["words"] or 0), None, first["n"]
    left, weights = everything, first["weights"] or 0
    while n_open:
        rate = left / weights
        above = F.col("weight") * rate > limit
        shut = rows.agg(
            F.sum(F.when(above, F.col("source_size"))).alias("words"), F.sum(F.when(~above, F.col("weight"))).alias("weights"),
            F.count_if(~above).alias("n"),
        ).first()
        if shut["n"] == n_open:
            break
        # the rate only rises, so what is shut stays shut
        left, weights, n_open = everything - max_rate * (shut["words"] or 0), shut["weights"], shut["n"]
        rate = None
    share = limit if rate is None else F.least(limit, F.col("weight") * rate)
    return rows.select("source", "source_size", share.alias("target"))


def plan(spark: SparkSession, sizes: DataFrame, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """``of`` (the source), source_size, target, whole, fraction, seed: one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = stored(spark, targets(spark, totals, budget, max_rate), "mix-targets")
    rates = per_source.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = rates.withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("whole"))
    rates = rates.withColumnRenamed("source", "of")

    hit = [draw(F.col("first"), F.col("stride"), F.lit(k)) < F.col("fraction") for k in range(SEEDS)]
    sums = [F.sum(F.when(h, F.col("size")).otherwise(0)).alias(f"s{k}") for k, h in enumerate(hit)]
    drawn = _with_plan(sizes, rates).groupBy("of").agg(F.sum(F.col("size") * F.col("whole")).alias("base"), *sums)
    drawn = drawn.withColumnRenamed("of", "source")
    both = rates.join(drawn, F.col("of").eqNullSafe(F.col("source")))
    off = [F.abs(F.col("base") + F.col(f"s{k}") - F.col("target")) for k in range(SEEDS)]
    seed = F.array_min(F.array(*[F.struct(o.alias("off"), F.lit(k).alias("seed")) for k, o in enumerate(off)]))["seed"]
    return stored(spark, both.select("of", "source_size", "target", "whole", "fraction", seed.alias("seed")), "mix-plan")


def _with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with the plan of their source; the plan is sent to the tasks if it is counted to be small."""
    small = planned.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES
    return rows.join(F.broadcast(planned) if small else planned, rows["source"].cast("string").eqNullSafe(planned["of"]))


def mix(spark: SparkSession, docs: DataFrame, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document."""
    sizes = stored(spark, measured(docs), "mix-sizes")
    mixed = _with_plan(sizes, plan(spark, sizes, budget, max_rate))
    mixed = mixed.withColumn("copies", copies(F.col("first"), F.col("stride")))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeat(spark: SparkSession, docs: DataFrame, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as they were."""
    planned = plan(spark, stored(spark, measured(docs), "mix-sizes"), budget, max_rate)
    times = copies(*draw_numbers())
    own = [F.col(f"`{c}`") for c in docs.columns]
    boxed = docs.select(F.struct(*own).alias("row"), "doc_id", "source", "text")
    taken = _with_plan(boxed, planned).select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return taken.select("row.*")
