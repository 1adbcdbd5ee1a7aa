"""Building-block queries: each isolates one operator family on the derived tables.

They reuse the library's operators and the marts' intermediate steps, so the keys in
the registry show each operator on its own (filters, joins, aggregates, windows,
sorts, unions, calendar and numeric functions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.config import Filters
from revlens.functions.columns import (
    avg_of_doubles,
    bucket30,
    elapsed_days,
    exact_avg,
    month_start,
    round_to,
    safe_rate,
)
from revlens.operators.median import exact_median
from revlens.operators.quality import check_unique
from revlens.operators.reshape import one_row
from revlens.operators.spine import calendar_columns
from revlens.plans import marts as M
from revlens.plans.dashboard import filter_predicate
from revlens.plans.model import Warehouse
from revlens.sources.values import CLOSED_STAGES, DEAL_STAGES


def op_distinct(wh: Warehouse) -> DataFrame:
    return wh.ref("dim_account").select("segment", "region", "acquisition_channel").distinct()


def op_filter_predicates(wh: Warehouse) -> DataFrame:
    d = wh.ref("stg_crm_deals")
    v = F.col("deal_value")
    keep = (
        F.col("stage").isin(*CLOSED_STAGES)
        & F.col("account_id").isNotNull()
        & F.col("sales_cycle_days").between(30, 60)
        & (v <= 250000)
        & ~((v - 1000) < 0)
        & (F.col("segment") == "SMB")
    )
    return d.where(keep).select("deal_id", "account_id", "stage", "deal_value", "sales_cycle_days")


def _paid_by_month(wh: Warehouse) -> DataFrame:
    """Paid revenue per account-month with the previous month's value (lag per account)."""
    monthly = M.paid_invoices(wh).groupBy("account_id", month_start(F.col("invoice_date")).alias("month")).agg(
        F.sum("amount").alias("paid")
    )
    w = Window.partitionBy("account_id").orderBy("month")
    return monthly.withColumn("prev_paid", F.lag("paid").over(w))


def op_post_window_filter(wh: Warehouse) -> DataFrame:
    """Months whose paid revenue differs from the previous month (filter after the window)."""
    p = _paid_by_month(wh)
    return p.where(F.col("prev_paid").isNull() | (F.col("paid") != F.col("prev_paid")))


def op_abs_filter(wh: Warehouse) -> DataFrame:
    p = _paid_by_month(wh)
    change = F.coalesce(F.col("paid") - F.col("prev_paid"), F.lit(0))
    return p.select("account_id", "month", change.alias("change")).where(F.abs(F.col("change")) > 100)


def op_scalar_subquery(wh: Warehouse) -> DataFrame:
    r = wh.ref("fct_revenue_monthly")
    latest = r.agg(F.max("revenue_month")).scalar()
    return r.where(F.col("revenue_month") == latest).agg(
        F.max("revenue_month").alias("month"), F.sum("mrr").alias("total_mrr"), F.count(F.lit(1)).alias("accounts")
    )


def op_dynamic_filter(wh: Warehouse) -> DataFrame:
    flt = Filters(segment="SMB", region="ASIA", channel="Events")
    pred = filter_predicate(flt, segment="segment", region="region", channel="acquisition_channel")
    return wh.ref("dim_account").where(pred).select("account_id", "segment", "region", "acquisition_channel")


def op_left_join(wh: Warehouse) -> DataFrame:
    return M.user_activation(wh)


def op_left_join_residual(wh: Warehouse) -> DataFrame:
    return M.monthly_revenue(wh)


def op_left_to_inner(wh: Warehouse) -> DataFrame:
    return M.channel_attribution(wh)


def op_small_side_left_join(wh: Warehouse) -> DataFrame:
    return M.channel_spend_attribution(wh)


def op_inner_join_residual(wh: Warehouse) -> DataFrame:
    """Paid invoices inside their subscription's dates, per account (join + residual)."""
    i = M.paid_invoices(wh).select("subscription_id", "account_id", "invoice_date", "amount")
    s = wh.ref("stg_subscriptions").select(F.col("subscription_id").alias("_sid"), "start_date", "end_date")
    inside = (F.col("invoice_date") >= F.col("start_date")) & (
        F.col("end_date").isNull() | (F.col("invoice_date") <= F.col("end_date"))
    )
    j = i.join(s, i["subscription_id"] == s["_sid"]).where(inside)
    return j.groupBy("account_id").agg(F.count(F.lit(1)).alias("invoices"), F.sum("amount").alias("amount"))


def op_subscription_months(wh: Warehouse) -> DataFrame:
    return M.subscription_months(wh)


def op_cross_one_row(wh: Warehouse) -> DataFrame:
    a = wh.ref("stg_accounts").agg(F.count(F.lit(1)).alias("accounts"))
    d = wh.ref("stg_crm_deals").agg(F.count(F.lit(1)).alias("deals"))
    t = wh.ref("stg_support_tickets").agg(F.count(F.lit(1)).alias("tickets"))
    return one_row(wh.spark, a, d, t)


def op_function_key_join(wh: Warehouse) -> DataFrame:
    """Accounts joined to their cohort's bucket-1 retention on a computed month key."""
    a = wh.ref("stg_accounts").select("account_id", "created_at")
    r = wh.ref("fct_retention").where(F.col("months_since_cohort") == 1).select("cohort_month", "retention_rate")
    j = a.join(r, month_start(F.col("created_at")) == r["cohort_month"])
    return j.select("account_id", "cohort_month", "retention_rate")


def op_anti_join(wh: Warehouse) -> DataFrame:
    """Users whose account does not exist."""
    u = wh.ref("stg_users").select("user_id", "account_id")
    a = wh.ref("stg_accounts").select(F.col("account_id").alias("_aid"))
    return u.join(a, u["account_id"] == a["_aid"], "left_anti")


def op_agg_basic(wh: Warehouse) -> DataFrame:
    d = wh.ref("stg_crm_deals")
    v, st = F.col("deal_value"), F.col("stage")
    return d.groupBy("segment").agg(
        F.count(F.lit(1)).alias("deals"),
        F.count("account_id").alias("with_account"),
        F.sum(v).alias("total_value"),
        F.max(v).alias("max_value"),
        exact_avg(v).alias("avg_value"),
        F.sum(F.when(st == "Closed Won", v).otherwise(0)).alias("won_value"),
        F.sum(F.when(st == "Closed Lost", v).otherwise(0)).alias("lost_value"),
    )


def op_count_distinct(wh: Warehouse) -> DataFrame:
    p = M.paid_invoices(wh)
    return p.groupBy(month_start(F.col("invoice_date")).alias("month")).agg(
        F.countDistinct("account_id").alias("paying_accounts")
    )


def op_filtered_agg(wh: Warehouse) -> DataFrame:
    t = wh.ref("stg_support_tickets")
    sev = F.col("severity")
    return t.groupBy("account_id").agg(
        F.count_if(sev == "Critical").alias("critical"),
        F.count_if(F.col("sla_breached")).alias("breached"),
        F.min(F.when(sev == "High", F.col("created_at"))).alias("first_high"),
    )


def op_null_as_zero_avg(wh: Warehouse) -> DataFrame:
    r = wh.ref("fct_revenue_monthly")
    return r.groupBy("revenue_month").agg(
        avg_of_doubles(F.coalesce(F.col("nrr"), F.lit(0.0))).alias("avg_nrr")
    )


def op_median(wh: Warehouse) -> DataFrame:
    """Exact interpolated median deal value per segment and stage."""
    return exact_median(wh.ref("stg_crm_deals"), ["segment", "stage"], "deal_value", "median_deal_value")


def op_two_level_agg(wh: Warehouse) -> DataFrame:
    return M.cohort_retention(wh)


def op_safe_rate(wh: Warehouse) -> DataFrame:
    d = wh.ref("stg_crm_deals")
    won = F.count_if(F.col("stage") == "Closed Won")
    closed = F.count_if(F.col("stage").isin(*CLOSED_STAGES))
    g = d.groupBy("segment").agg(won.alias("won"), closed.alias("closed"))
    return g.select("segment", "won", "closed", safe_rate(F.col("won"), F.col("closed"), 3).alias("win_rate"))


def op_value_counts(wh: Warehouse) -> DataFrame:
    return wh.ref("stg_crm_deals").groupBy("stage").agg(F.count(F.lit(1)).alias("count"))


def op_pivot(wh: Warehouse) -> DataFrame:
    """Deal counts as a segment x stage matrix; stages outside the known ones are ``other``."""
    d = wh.ref("stg_crm_deals").where(F.col("stage").isNotNull())
    known = F.when(F.col("stage").isin(*DEAL_STAGES), F.col("stage")).otherwise("other")
    return d.select("segment", known.alias("stage")).groupBy("segment").pivot("stage", [*DEAL_STAGES, "other"]).agg(F.count(F.lit(1)))


def op_duplicate_keys(wh: Warehouse) -> DataFrame:
    return check_unique(wh.ref("stg_crm_deals"), "stg_crm_deals", ["account_id", "created_date"])


def op_lag_lead(wh: Warehouse) -> DataFrame:
    return M.revenue_with_lag(wh).select("account_id", "revenue_month", "mrr", "prev_mrr", "next_mrr")


def op_pct_change(wh: Warehouse) -> DataFrame:
    return M.metric_changes(wh)


def op_top_k(wh: Warehouse, k: int = 50) -> DataFrame:
    r = wh.ref("fct_revenue_monthly")
    top = r.orderBy(F.desc("revenue_month"), F.desc(F.abs(F.col("revenue_change"))), "account_id").limit(k)
    return top.select("revenue_month", "account_id", "mrr", "revenue_change", "revenue_type")


def op_union_all(wh: Warehouse) -> DataFrame:
    i = wh.ref("stg_invoices").where(F.col("status") == "Failed").select(
        "invoice_id", "account_id", "invoice_date", F.col("amount").cast("decimal(38,2)").alias("amount")
    )
    r = wh.ref("fct_revenue_monthly").where(F.col("revenue_type") == "churned").select(
        F.lit(None).cast(i.schema["invoice_id"].dataType).alias("invoice_id"),
        "account_id",
        F.col("revenue_month").alias("invoice_date"),
        F.col("churned_mrr").cast("decimal(38,2)").alias("amount"),
    )
    return i.unionByName(r)


def op_metric_unpivot(wh: Warehouse) -> DataFrame:
    return M.monthly_metrics(wh)


def op_tagged_union(wh: Warehouse) -> DataFrame:
    """Ended subscriptions (4 columns) and their final-month invoices (5 columns), tagged."""
    s = wh.ref("stg_subscriptions").where(F.col("end_date").isNotNull())
    subs = s.select(F.lit("subscription").alias("kind"), "subscription_id", "account_id", "start_date", "end_date")
    ends = s.select(F.col("subscription_id").alias("_sid"), "start_date", "end_date")
    i = wh.ref("stg_invoices").select("subscription_id", "account_id", "invoice_date")
    last = i.join(ends, i["subscription_id"] == ends["_sid"]).where(
        month_start(F.col("invoice_date")) == month_start(F.col("end_date"))
    )
    invs = last.select(
        F.lit("invoice").alias("kind"),
        F.lit(None).cast(s.schema["subscription_id"].dataType).alias("subscription_id"),
        "account_id", "invoice_date", "start_date", "end_date",
    )
    return subs.unionByName(invs, allowMissingColumns=True)


def op_calendar_fns(wh: Warehouse) -> DataFrame:
    """Calendar attributes of every distinct deal creation date."""
    days = wh.ref("stg_crm_deals").select(F.col("created_date").alias("d")).distinct()
    return days.select(*calendar_columns(F.col("d")))


def op_elapsed_and_bucket(wh: Warehouse) -> DataFrame:
    d = wh.ref("stg_crm_deals").where(F.col("closed_date").isNotNull())
    return d.select(
        "deal_id",
        elapsed_days(F.col("closed_date"), F.col("created_date")).alias("elapsed_days"),
        bucket30(month_start(F.col("closed_date")), month_start(F.col("created_date"))).alias("months_bucket"),
    )


def op_round_case_cast(wh: Warehouse) -> DataFrame:
    p = wh.ref("fct_pipeline")
    n = F.col("deal_count")
    return p.select(
        "segment", "stage",
        round_to(F.col("avg_sales_cycle_days"), 1).alias("cycle_1dp"),
        F.when(n >= 2000, "large").when(n >= 500, "medium").otherwise("small").alias("size_class"),
        n.cast("string").alias("deal_count_text"),
        F.coalesce(F.col("win_rate") * 100, F.lit(0)).alias("win_pct"),
    )


OPERATOR_QUERIES = {
    name: fn for name, fn in globals().items() if name.startswith("op_") and callable(fn)
}
