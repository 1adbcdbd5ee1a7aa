"""Dashboard queries (the analytic API), each ``(Warehouse, Filters) -> DataFrame``.

Global filters are bound values folded into one predicate over the account
dimension (never pasted into SQL text). Facts join the dimension on account_id;
the dimension is projected to the filter columns first so the join carries little.
Ordering is applied only here, at the final consumer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.config import NO_FILTERS, Filters
from revlens.functions.columns import avg_of_doubles, conjunction, exact_avg
from revlens.operators.reshape import cohort_pivot, one_row
from revlens.plans.model import Warehouse
from revlens.sources.values import CLOSED_STAGES

DIM_COLS = {"segment": "da_segment", "region": "da_region", "acquisition_channel": "da_channel"}


def filter_predicate(filters: Filters, segment: str = "da_segment", region: str = "da_region",
                     channel: str = "da_channel") -> Column:
    """Conjunction of the chosen filter values; ``true`` when nothing is chosen."""
    f = filters.normalized()
    preds = []
    if f.segment is not None:
        preds.append(F.col(segment) == F.lit(f.segment))
    if f.region is not None:
        preds.append(F.col(region) == F.lit(f.region))
    if f.channel is not None:
        preds.append(F.col(channel) == F.lit(f.channel))
    return conjunction(preds)


def _dim(wh: Warehouse) -> DataFrame:
    return wh.ref("dim_account").select(
        F.col("account_id").alias("da_account_id"),
        *[F.col(c).alias(a) for c, a in DIM_COLS.items()],
        F.col("created_at").alias("da_created_at"),
    )


def _with_dim(fact: DataFrame, wh: Warehouse, filters: Filters) -> DataFrame:
    """Inner join fact -> account dimension, filtered by the global filters."""
    da = _dim(wh)
    return fact.join(da, fact["account_id"] == da["da_account_id"]).where(filter_predicate(filters))


def _latest_month(wh: Warehouse) -> Column:
    """The latest revenue month (unfiltered); from the partition folders where the fact is written."""
    return wh.latest("fct_revenue_monthly", "revenue_month")


def dash_filter_options(wh: Warehouse) -> DataFrame:
    """Filter choices per dimension: ``All`` first, then the sorted non-null values."""
    combos = wh.ref("dim_account").select("segment", "region", "acquisition_channel").distinct()
    values = combos.unpivot([], ["segment", "region", "acquisition_channel"], "dimension", "value")
    values = values.where(F.col("value").isNotNull()).distinct()
    ranked = values.withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy("value")))
    alls = values.select("dimension").distinct().select(
        "dimension", F.lit("All").alias("value"), F.lit(0).alias("position")
    )
    return ranked.unionByName(alls).orderBy("dimension", "position")


def dash_kpis(wh: Warehouse, filters: Filters = NO_FILTERS) -> DataFrame:
    """One KPI row: latest-month revenue metrics, mean activation rate, mean CAC."""
    r = wh.ref("fct_revenue_monthly").where(F.col("revenue_month") == _latest_month(wh))
    current = _with_dim(r, wh, filters).agg(
        F.sum("mrr").alias("current_mrr"),
        F.sum("arr").alias("current_arr"),
        avg_of_doubles(F.coalesce(F.col("nrr"), F.lit(0.0))).alias("avg_nrr"),
        F.sum("churned_mrr").alias("churned_mrr"),
        F.countDistinct("account_id").alias("active_accounts"),
    )
    activation = _with_dim(wh.ref("fct_activation"), wh, filters).agg(
        exact_avg(F.col("activation_rate")).alias("avg_activation_rate")
    )
    cac = wh.ref("fct_cac_ltv").agg(exact_avg(F.col("cac")).alias("avg_cac"))
    row = one_row(wh.spark, current, activation, cac)
    return row.select(
        "*",
        F.coalesce(F.col("avg_nrr") * 100, F.lit(0.0)).alias("nrr_pct"),
        F.coalesce(F.col("avg_activation_rate") * 100, F.lit(0.0)).alias("activation_pct"),
    )


def dash_mrr_trend(wh: Warehouse, filters: Filters = NO_FILTERS) -> DataFrame:
    """Monthly total, new, expansion and churned MRR."""
    r = _with_dim(wh.ref("fct_revenue_monthly"), wh, filters)
    return r.groupBy("revenue_month").agg(
        F.sum("mrr").alias("total_mrr"),
        F.sum("new_mrr").alias("new_mrr"),
        F.sum("expansion_mrr").alias("expansion_mrr"),
        F.sum("churned_mrr").alias("churned_mrr"),
    ).orderBy("revenue_month")


def dash_segment_revenue(wh: Warehouse, filters: Filters = NO_FILTERS) -> DataFrame:
    """Latest-month MRR per segment, largest first."""
    r = wh.ref("fct_revenue_monthly").where(F.col("revenue_month") == _latest_month(wh))
    return (
        _with_dim(r, wh, filters)
        .groupBy(F.col("da_segment").alias("segment"))
        .agg(F.sum("mrr").alias("total_mrr"))
        .orderBy(F.desc("total_mrr"), "segment")
    )


def dash_win_rate(wh: Warehouse) -> DataFrame:
    """Win rate per segment (one row per stage row of the mart, duplicates kept)."""
    p = wh.ref("fct_pipeline")
    return p.where(F.col("win_rate").isNotNull()).select("segment", "win_rate", "won_deals", "lost_deals").orderBy(
        "segment"
    )


def dash_sales_cycle(wh: Warehouse) -> DataFrame:
    """Average sales cycle of won deals per segment."""
    p = wh.ref("fct_pipeline")
    return p.where(F.col("stage") == "Closed Won").select("segment", "avg_sales_cycle_days").orderBy("segment")


def dash_deal_value(wh: Warehouse) -> DataFrame:
    """Average deal value and count of closed deals per segment and stage."""
    p = wh.ref("fct_pipeline")
    return (
        p.where(F.col("stage").isin(*CLOSED_STAGES))
        .select("segment", "stage", "avg_deal_value", "deal_count")
        .orderBy("segment", "stage")
    )


def dash_cohort_heatmap(wh: Warehouse, max_bucket: int = 12) -> DataFrame:
    """Cohort x bucket retention matrix in percent: a column for each bucket 0..max_bucket, and
    the earlier buckets in the map ``before``."""
    r = wh.ref("fct_retention")
    m = cohort_pivot(r, "cohort_month", "months_since_cohort", F.col("retention_rate") * 100, max_bucket)
    return m.orderBy("cohort_month")


def dash_metric_choices(wh: Warehouse, k: int = 50) -> DataFrame:
    """The metrics among the recent anomalies, i.e. the choices of the metric trend."""
    return dash_recent_anomalies(wh, k).select("metric_name").distinct().orderBy("metric_name")


def dash_activation_vs_retention(wh: Warehouse, filters: Filters = NO_FILTERS, bucket: int = 6) -> DataFrame:
    """Per segment: mean account activation rate vs mean cohort retention at a bucket.

    The retention side holds one row per cohort month at that bucket, so it is bounded
    by the number of months in the calendar.
    """
    a = _with_dim(wh.ref("fct_activation"), wh, filters)
    r = wh.ref("fct_retention").where(F.col("months_since_cohort") == bucket).select(
        "cohort_month", F.col("retention_rate").alias("_retention")
    )
    j = a.join(r, F.trunc(F.to_date("da_created_at"), "MM") == r["cohort_month"])
    return j.groupBy("segment").agg(
        exact_avg(F.col("activation_rate")).alias("avg_activation"),
        exact_avg(F.col("_retention")).alias("avg_retention"),
    )


def dash_churn_by_cohort(wh: Warehouse, lo: int = 3, hi: int = 6) -> DataFrame:
    """Mean churn rate per cohort over buckets lo..hi (inclusive)."""
    r = wh.ref("fct_retention").where(F.col("months_since_cohort").between(lo, hi))
    return r.groupBy("cohort_month").agg(exact_avg(F.col("churn_rate")).alias("avg_churn_rate")).orderBy(
        "cohort_month"
    )


def dash_support_summary(wh: Warehouse, filters: Filters = NO_FILTERS) -> DataFrame:
    """One row: total tickets, mean breach rate, mean resolution hours (unweighted)."""
    s = _with_dim(wh.ref("fct_support"), wh, filters)
    return s.agg(
        F.sum("total_tickets").alias("total_tickets"),
        exact_avg(F.col("sla_breach_rate")).alias("avg_sla_breach_rate"),
        exact_avg(F.col("avg_resolution_hours")).alias("avg_resolution_hours"),
    )


def dash_tickets_by_segment(wh: Warehouse, filters: Filters = NO_FILTERS) -> DataFrame:
    """Ticket volume per segment, busiest first."""
    s = _with_dim(wh.ref("fct_support"), wh, filters)
    return (
        s.groupBy(F.col("da_segment").alias("segment"))
        .agg(
            F.sum("total_tickets").alias("tickets"),
            F.sum("critical_tickets").alias("critical"),
            F.sum("high_tickets").alias("high"),
        )
        .orderBy(F.desc("tickets"), "segment")
    )


def dash_sla_by_region(wh: Warehouse, filters: Filters = NO_FILTERS) -> DataFrame:
    """Mean breach rate and mean of median resolution hours per region."""
    s = _with_dim(wh.ref("fct_support"), wh, filters)
    return (
        s.groupBy(F.col("da_region").alias("region"))
        .agg(
            exact_avg(F.col("sla_breach_rate")).alias("breach_rate"),
            exact_avg(F.col("median_resolution_hours")).alias("median_res_hours"),
        )
        .orderBy(F.desc("breach_rate"), "region")
    )


def dash_recent_anomalies(wh: Warehouse, k: int = 50) -> DataFrame:
    """The k most recent anomalies, largest change first within a month (top-k)."""
    a = wh.ref("fct_anomalies")
    return a.orderBy(F.desc("metric_month"), F.desc(F.abs(F.col("pct_change"))), "metric_name").limit(k)


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def dash_anomaly_type_counts(wh: Warehouse, k: int = 50) -> DataFrame:
    """Anomaly type counts over the recent-anomalies list."""
    return _value_counts(dash_recent_anomalies(wh, k), "anomaly_type")


def dash_anomaly_severity_counts(wh: Warehouse, k: int = 50) -> DataFrame:
    """Severity counts over the recent-anomalies list."""
    return _value_counts(dash_recent_anomalies(wh, k), "anomaly_severity")


def dash_metric_trend(wh: Warehouse, metric: str | None = None, k: int = 50) -> DataFrame:
    """Monthly anomalies of one metric; by default the metric of the top recent anomaly."""
    a = wh.ref("fct_anomalies")
    if metric is not None:
        chosen = a.where(F.col("metric_name") == F.lit(metric))
    else:
        top = dash_recent_anomalies(wh, k).limit(1).select(F.col("metric_name").alias("_chosen"))
        chosen = a.join(top, a["metric_name"] == top["_chosen"])
    return chosen.select("metric_month", "metric_value", "pct_change").orderBy("metric_month")
