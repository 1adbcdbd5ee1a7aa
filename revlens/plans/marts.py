"""The nine marts (dimensions and facts), each ``Warehouse -> DataFrame``.

Semantics follow the modelled SQL exactly, including its odd corners (documented per
mart). Plan notes per mart say where the shuffles are and why they stay bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import (
    bucket30,
    classify_movement,
    elapsed_days,
    exact_avg,
    exact_ratio,
    money_sum,
    month_start,
    revenue_change,
    round_to,
    safe_rate,
)
from revlens.operators.median import exact_median
from revlens.operators.reshape import unpivot_metrics
from revlens.operators.spine import calendar, deal_out, month_spine
from revlens.operators.windows import lag_lead, pct_change
from revlens.plans.model import Warehouse, mart
from revlens.sources.values import CLOSED_STAGES

MONEY = "decimal(38,2)"  # totals over many rows
ROW_MONEY = "decimal(18,2)"  # one account-month: fits a long, keeps arithmetic compact


@mart("dim_date")
def dim_date(wh: Warehouse) -> DataFrame:
    """One row per calendar day of the horizon."""
    return calendar(wh.spark, wh.horizon)


@mart("dim_account")
def dim_account(wh: Warehouse) -> DataFrame:
    """Accounts with their subscription; an account with n subscriptions gives n rows."""
    a = wh.ref("stg_accounts")
    s = wh.ref("stg_subscriptions").select(
        F.col("account_id").alias("_sub_account"),
        F.col("plan_tier").alias("current_plan_tier"),
        F.col("start_date").alias("subscription_start_date"),
        F.col("status").alias("_sub_status"),
    )
    j = a.join(s, a["account_id"] == s["_sub_account"], "left")
    return j.select(
        "account_id", "account_name", "segment", "company_size", "region", "acquisition_channel",
        "created_at", "status", "current_plan_tier", "subscription_start_date",
        F.when(F.col("_sub_status") == "Active", 1).otherwise(0).alias("is_active_subscriber"),
    )


def paid_invoices(wh: Warehouse) -> DataFrame:
    return wh.ref("stg_invoices").where(F.col("status") == "Paid")


def subscription_months(wh: Warehouse) -> DataFrame:
    """One row per subscription and month it was active (start month .. end or horizon).

    The subscriptions are dealt out by account before they expand: they are few bytes, which
    one task may hold, but many months.
    """
    h = wh.horizon
    subs = wh.ref("stg_subscriptions").select("account_id", "subscription_id", "start_date", "end_date")
    months = month_spine(
        deal_out(subs, "account_id", h),
        month_start(F.col("start_date")),
        F.coalesce(month_start(F.col("end_date")), F.lit(h.open_end)),
        h,
        name="revenue_month",
    )
    return months.select("account_id", "subscription_id", "revenue_month", "end_date")


def monthly_revenue(wh: Warehouse) -> DataFrame:
    """Per account-month: paid invoice total (x overlapping subscriptions) and end date.

    Instead of ``left join invoices on (account, month, status)`` followed by a group by,
    both inputs are unioned and aggregated once (a co-group): ``n_sub`` subscription
    rows and ``paid`` invoice total give ``mrr = n_sub * paid``, exactly the join's
    fan-out sum; ``max(end_date)`` ignores nulls as before. Invoices are summed per
    account-month first, so a hot account is one row a month; then both inputs are dealt
    out by account, subscriptions before they expand. The aggregation and the window
    behind it find their rows in place.
    """
    sub_rows = subscription_months(wh).select(
        "account_id", "revenue_month", F.lit(1).alias("n_sub"), "end_date",
        F.lit(None).cast("decimal(18,2)").alias("amount"),
    )
    # a null account never equals another one, so its invoices join no subscription
    invoiced = (
        paid_invoices(wh)
        .where(F.col("account_id").isNotNull())
        .groupBy("account_id", month_start(F.col("invoice_date")).alias("revenue_month"))
        .agg(money_sum("amount").cast("decimal(18,2)").alias("amount"))
    )
    inv_rows = deal_out(invoiced, "account_id", wh.horizon).select(
        "account_id", "revenue_month", F.lit(0).alias("n_sub"), F.lit(None).cast("date").alias("end_date"), "amount"
    )
    return (
        sub_rows.unionByName(inv_rows)
        .groupBy("account_id", "revenue_month")
        .agg(
            F.sum("n_sub").alias("n_sub"),
            money_sum("amount").alias("paid"),
            F.max("end_date").alias("subscription_end_date"),
        )
        .where(F.col("n_sub") > 0)
        .select(
            "account_id", "revenue_month",
            F.coalesce(F.col("paid") * F.col("n_sub"), F.lit(0)).cast(ROW_MONEY).alias("mrr"),
            "subscription_end_date",
        )
    )


def revenue_with_lag(wh: Warehouse) -> DataFrame:
    """Previous and next month's mrr per account (zero months included).

    The account-months lie by account already; each window partition holds at most the
    calendar's months, whatever the skew of the raw rows.
    """
    return lag_lead(monthly_revenue(wh), "mrr", ["account_id"], "revenue_month", prev="prev_mrr", nxt="next_mrr")


@mart("fct_revenue_monthly")
def fct_revenue_monthly(wh: Warehouse) -> DataFrame:
    """Account x month revenue movements (new, expansion, contraction, churned, maintained).

    Classification runs after the window and the final filter after the
    classification, so zero months still serve as previous/next rows.
    """
    lagged = revenue_with_lag(wh)
    mrr, prev = F.col("mrr"), F.col("prev_mrr")
    typed = lagged.select(
        "revenue_month", "account_id", "mrr",
        F.coalesce(prev, F.lit(0)).cast(ROW_MONEY).alias("prior_month_mrr"),
        revenue_change(mrr, prev).cast(ROW_MONEY).alias("revenue_change"),
        classify_movement(mrr, prev, F.col("next_mrr"), F.col("subscription_end_date")).alias("revenue_type"),
    )
    t, change, prior = F.col("revenue_type"), F.col("revenue_change"), F.col("prior_month_mrr")
    zero = F.lit(0).cast(ROW_MONEY)
    expansion = F.when(t == "expansion", change).otherwise(zero)
    contraction = F.when(t == "contraction", change).otherwise(zero)
    return typed.where((mrr > 0) | (t == "churned")).select(
        "revenue_month", "account_id", "mrr",
        (mrr * 12).cast(ROW_MONEY).alias("arr"),
        "prior_month_mrr", "revenue_change", "revenue_type",
        F.when(t == "new", mrr).otherwise(zero).alias("new_mrr"),
        expansion.alias("expansion_mrr"),
        contraction.alias("contraction_mrr"),
        F.when(t == "churned", prior).otherwise(zero).alias("churned_mrr"),
        F.when(prior > 0, exact_ratio(mrr - prior + expansion - contraction, prior)).alias("nrr"),
    )


@mart("fct_pipeline")
def fct_pipeline(wh: Warehouse) -> DataFrame:
    """Segment x stage deal metrics with the segment's win rate on every stage row.

    One aggregation over the deals; the win rate is derived from the (tiny) aggregate
    with a per-segment window instead of a second scan and join. Segments without a
    closed deal get null win columns (like the outer join they replace), and so does a
    null segment, which equals no segment in that join.
    """
    d = wh.ref("stg_crm_deals")
    dm = d.groupBy("segment", "stage").agg(
        F.count(F.lit(1)).alias("deal_count"),
        exact_avg(F.col("deal_value")).alias("avg_deal_value"),
        F.sum("deal_value").alias("total_deal_value"),
        exact_avg(F.col("sales_cycle_days")).alias("avg_sales_cycle_days"),
    )
    seg = Window.partitionBy("segment")
    n = F.col("deal_count")
    closed = F.sum(F.when(F.col("stage").isin(*CLOSED_STAGES), n)).over(seg)
    won = F.sum(F.when(F.col("stage") == "Closed Won", n).otherwise(0)).over(seg)
    lost = F.sum(F.when(F.col("stage") == "Closed Lost", n).otherwise(0)).over(seg)
    known = closed.isNotNull() & F.col("segment").isNotNull()
    return dm.select(
        "segment", "stage", "deal_count", "avg_deal_value", "total_deal_value", "avg_sales_cycle_days",
        F.when(known, safe_rate(won, closed, 3)).alias("win_rate"),
        F.when(known, won).alias("won_deals"),
        F.when(known, lost).alias("lost_deals"),
    )


def _dim_attrs(wh: Warehouse, *cols: str) -> DataFrame:
    return wh.ref("dim_account").select(F.col("account_id").alias("_dim_account"), *cols)


def user_activation(wh: Warehouse) -> DataFrame:
    """Per user: account, creation time and first activation time (null if none).

    Activation events are reduced to one row per user before the left join (partial
    aggregation); the per-user regrouping reuses the join's partitioning on user_id.
    """
    users = wh.ref("stg_users").select("user_id", "account_id", F.col("created_at").alias("user_created_at"))
    first_activation = (
        wh.ref("stg_product_events")
        .where(F.col("event_type") == "activation")
        .groupBy(F.col("user_id").alias("_event_user"))
        .agg(F.min("event_timestamp").alias("activation_timestamp"))
    )
    return (
        users.join(first_activation, users["user_id"] == first_activation["_event_user"], "left")
        .groupBy("user_id", "account_id", "user_created_at")
        .agg(F.min("activation_timestamp").alias("activation_timestamp"))
    )


@mart("fct_activation")
def fct_activation(wh: Warehouse) -> DataFrame:
    """Per account: users, activated users, activation rate, median days to activate."""
    ua = user_activation(wh).withColumn(
        "_days", elapsed_days(F.col("activation_timestamp"), F.col("user_created_at"))
    )
    metrics = ua.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count("activation_timestamp").alias("activated_users"),
    )
    med = exact_median(ua, ["account_id"], "_days", "_median", written=wh.step).withColumnRenamed("account_id", "_med_account")
    m = metrics.join(med, metrics["account_id"] == med["_med_account"], "left")
    dim = _dim_attrs(wh, "segment", "acquisition_channel")
    return m.join(dim, m["account_id"] == dim["_dim_account"]).select(
        "account_id", "segment", "acquisition_channel", "total_users", "activated_users",
        safe_rate(F.col("activated_users"), F.col("total_users"), 3).alias("activation_rate"),
        round_to(F.col("_median"), 1).alias("median_days_to_activate"),
    )


def account_cohorts(wh: Warehouse) -> DataFrame:
    return wh.ref("stg_accounts").select("account_id", month_start(F.col("created_at")).alias("cohort_month"))


def cohort_retention(wh: Warehouse) -> DataFrame:
    """Cohort month x 30-day bucket: distinct active accounts and paid revenue.

    Paid invoices are first reduced to one row per account-month (partial aggregation,
    so a hot account contributes at most one row per month to the join); the two-level
    aggregation (cohort-bucket-account, then cohort-bucket) replaces count-distinct.
    """
    cohorts = account_cohorts(wh)
    monthly = paid_invoices(wh).groupBy(
        F.col("account_id").alias("_inv_account"), month_start(F.col("invoice_date")).alias("activity_month")
    ).agg(money_sum("amount").alias("_paid"))
    activity = (
        cohorts.join(monthly, cohorts["account_id"] == monthly["_inv_account"])
        .withColumn("months_since_cohort", bucket30(F.col("activity_month"), F.col("cohort_month")))
        .groupBy("cohort_month", "months_since_cohort", "account_id")
        .agg(money_sum("_paid").alias("revenue"))
    )
    return activity.groupBy("cohort_month", "months_since_cohort").agg(
        F.count(F.lit(1)).alias("active_accounts"),
        money_sum("revenue").alias("cohort_revenue"),
    )


@mart("fct_retention")
def fct_retention(wh: Warehouse) -> DataFrame:
    """Retention and churn rates per cohort month and 30-day bucket.

    The cohort-size side has one row per cohort month (bounded by the calendar).
    """
    cohorts = account_cohorts(wh)
    retention = cohort_retention(wh)
    sizes = cohorts.groupBy(F.col("cohort_month").alias("_size_month")).agg(F.count(F.lit(1)).alias("cohort_size"))
    j = retention.join(sizes, retention["cohort_month"] == sizes["_size_month"])
    rate = safe_rate(F.col("active_accounts"), F.col("cohort_size"), 3)
    return j.select(
        "cohort_month", "cohort_size", "months_since_cohort", "active_accounts", "cohort_revenue",
        rate.alias("retention_rate"),
        (F.lit(1) - rate).alias("churn_rate"),
    )


@mart("fct_support")
def fct_support(wh: Warehouse) -> DataFrame:
    """Per account ticket counts, SLA breach rate, mean and median resolution hours."""
    t = wh.ref("stg_support_tickets")
    sev = F.col("severity")
    # exact sum of the stored values (ten decimals), rounded once at the end
    hours = F.col("resolution_hours").cast("decimal(28,10)")
    tm = t.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(sev == "Critical").alias("critical_tickets"),
        F.count_if(sev == "High").alias("high_tickets"),
        F.count_if(F.col("sla_breached")).alias("sla_breached_tickets"),
        F.sum(hours).alias("_hours_sum"),
        F.count(hours).alias("_hours_n"),
    )
    med = exact_median(t, ["account_id"], "resolution_hours", "_median", written=wh.step).withColumnRenamed("account_id", "_med_account")
    m = tm.join(med, tm["account_id"] == med["_med_account"], "left")
    dim = _dim_attrs(wh, "segment", "region")
    avg_hours = F.col("_hours_sum") / F.when(F.col("_hours_n") > 0, F.col("_hours_n").cast("decimal(18,0)"))
    return m.join(dim, m["account_id"] == dim["_dim_account"]).select(
        "account_id", "segment", "region", "total_tickets", "critical_tickets", "high_tickets",
        "sla_breached_tickets",
        safe_rate(F.col("sla_breached_tickets"), F.col("total_tickets"), 3).alias("sla_breach_rate"),
        F.round(avg_hours, 1).alias("avg_resolution_hours"),
        round_to(F.col("_median"), 1).alias("median_resolution_hours"),
        (F.col("total_tickets") * 100).cast("decimal(20,2)").alias("tickets_per_100_accounts"),
    )


def channel_spend(wh: Warehouse) -> DataFrame:
    return wh.ref("stg_marketing_spend").groupBy("channel").agg(
        F.sum("spend").alias("total_spend"), F.sum("leads_generated").alias("total_leads")
    )


def channel_attribution(wh: Warehouse) -> DataFrame:
    """Per acquisition channel: paid invoices of its accounts and their revenue.

    Invoices are reduced per account before the join with accounts (the outer join
    of the modelled query is inner because of its filter on the invoice side).
    """
    per_account = paid_invoices(wh).groupBy(F.col("account_id").alias("_inv_account")).agg(
        F.count(F.lit(1)).alias("_n"), money_sum("amount").alias("_rev")
    )
    a = wh.ref("stg_accounts").select("account_id", "acquisition_channel")
    return (
        a.join(per_account, a["account_id"] == per_account["_inv_account"])
        .groupBy("acquisition_channel")
        .agg(F.sum("_n").alias("accounts_acquired"), money_sum("_rev").alias("total_revenue"))
    )


def channel_spend_attribution(wh: Warehouse) -> DataFrame:
    """Channel spend left-joined with attribution, both one row per channel."""
    spend = channel_spend(wh)
    attribution = channel_attribution(wh)
    j = spend.join(attribution, spend["channel"] == attribution["acquisition_channel"], "left")
    return j.select("channel", "total_spend", "total_leads", "accounts_acquired", "total_revenue")


@mart("fct_cac_ltv")
def fct_cac_ltv(wh: Warehouse) -> DataFrame:
    """Per marketing channel: spend, paid invoices, revenue, CAC, rough LTV, ROAS.

    ``accounts_acquired`` counts account x paid-invoice rows (i.e. paid invoices), as
    the modelled query does. Invoices are reduced per account before the join with
    accounts; both channel-level sides are bounded by the number of channels.
    """
    j = channel_spend_attribution(wh)
    n, rev, sp = F.col("accounts_acquired"), F.col("total_revenue"), F.col("total_spend")
    n_dec = n.cast("decimal(20,0)")
    cac = F.when(n > 0, F.round(sp.cast("decimal(20,2)") / n_dec, 2))
    ltv = F.when(n > 0, F.round(rev.cast("decimal(20,2)") / n_dec, 2))
    out = j.select(
        "channel", "total_spend", "total_leads",
        F.coalesce(n, F.lit(0)).alias("accounts_acquired"),
        F.coalesce(rev, F.lit(0)).cast(MONEY).alias("total_revenue"),
        cac.alias("cac"),
        ltv.alias("rough_ltv"),
        F.when(sp > 0, F.round(rev.cast("decimal(20,2)") / sp.cast("decimal(20,2)"), 2)).alias("roas"),
        F.when((n > 0) & (sp > 0), F.round(rev.cast("decimal(20,2)") / sp.cast("decimal(20,2)"), 1))
        .alias("ltv_cac_ratio"),
    )
    c, l = F.col("cac"), F.col("rough_ltv")
    return out.withColumn(
        "cac_payback_months", F.when((c > 0) & (l > 0), F.round(c / (l * F.lit(0.05).cast("decimal(3,2)")), 1))
    )


def monthly_metrics(wh: Warehouse) -> DataFrame:
    """Long form (month, metric name, value) of three monthly revenue totals.

    One aggregation by month feeds a one-pass unpivot (not one scan per metric).
    """
    r = wh.ref("fct_revenue_monthly")
    monthly = r.groupBy(F.col("revenue_month").alias("metric_month")).agg(
        money_sum("mrr").alias("_mrr"), money_sum("churned_mrr").alias("_churned"), money_sum("new_mrr").alias("_new")
    )
    long = unpivot_metrics(
        monthly, ["metric_month"],
        {"MRR": F.col("_mrr"), "Churned MRR": F.col("_churned"), "New MRR": F.col("_new")},
    )
    return long


def metric_changes(wh: Warehouse) -> DataFrame:
    """Previous month's value and the rounded percent change per metric (lag computed once).

    The window is keyed by metric name; each partition holds one row per month."""
    return pct_change(monthly_metrics(wh), "metric_value", ["metric_name"], "metric_month", prev="prev_month_value")


@mart("fct_anomalies")
def fct_anomalies(wh: Warehouse) -> DataFrame:
    """Months whose metric changed by more than 10% against the previous month."""
    changes = metric_changes(wh)
    pct = F.col("pct_change")
    return changes.where(F.abs(F.coalesce(pct, F.lit(0))) > 10).select(
        "metric_month", "metric_name", "metric_value", "prev_month_value", "pct_change",
        F.when(F.abs(pct) > 20, "High Change").when(F.abs(pct) > 10, "Moderate Change").otherwise("Normal")
        .alias("anomaly_severity"),
        F.when(pct > 20, "Spike").when(pct < -20, "Drop").otherwise("Normal").alias("anomaly_type"),
    )
