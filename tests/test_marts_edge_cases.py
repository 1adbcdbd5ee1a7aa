"""Edge cases of the marts on tiny hand-made frames."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import account, invoice, subscription, warehouse
from revlens.operators.windows import pct_change


def d(s):
    return dt.date.fromisoformat(s)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_revenue_branch_order_and_final_filter(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account(a) for a in ("A1", "A2", "A3", "A4")],
        raw_subscriptions=[subscription(f"S{i}", f"A{i}", "2025-01-01", "2025-02-28", "Cancelled") for i in range(1, 5)],
        raw_invoices=[
            invoice("I1", "S1", "A1", "2025-02-01", 99),  # 0 -> 99
            invoice("I2", "S2", "A2", "2025-01-01", 99),  # 99 -> 0
            invoice("I3", "S3", "A3", "2025-01-01", 99),  # 99 -> 99, ended
            invoice("I4", "S3", "A3", "2025-02-01", 99),
            invoice("I5", "S4", "A4", "2025-01-01", 50, status="Pending"),  # 0 -> 0, ended; not paid
        ],
    )
    r = wh.ref("fct_revenue_monthly")
    got = rows(r, "account_id", "revenue_month", "revenue_type", "mrr", "churned_mrr")
    assert got == [
        ("A1", d("2025-02-01"), "expansion", Decimal("99.00"), Decimal("0.00")),
        ("A2", d("2025-01-01"), "new", Decimal("99.00"), Decimal("0.00")),
        ("A3", d("2025-01-01"), "new", Decimal("99.00"), Decimal("0.00")),
        ("A3", d("2025-02-01"), "churned", Decimal("99.00"), Decimal("99.00")),
        ("A4", d("2025-02-01"), "churned", Decimal("0.00"), Decimal("0.00")),
    ]
    nrr = {(x["account_id"], x["revenue_month"]): x["nrr"] for x in r.collect()}
    assert nrr[("A1", d("2025-02-01"))] is None  # previous month 0
    assert nrr[("A3", d("2025-02-01"))] == 0.0


def test_fan_out_and_max_end_date(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account("A5")],
        raw_subscriptions=[
            subscription("S5a", "A5", "2025-03-01"),
            subscription("S5b", "A5", "2025-03-01", "2025-04-30", "Cancelled"),
        ],
        raw_invoices=[invoice("I1", "S5a", "A5", "2025-03-01", 99)],
    )
    assert wh.ref("dim_account").count() == 2
    from revlens.plans.marts import monthly_revenue

    m = {x["revenue_month"]: x for x in monthly_revenue(wh).collect()}
    assert m[d("2025-03-01")]["mrr"] == Decimal("198.00")  # two overlapping subscriptions
    assert m[d("2025-03-01")]["subscription_end_date"] == d("2025-04-30")
    assert m[d("2025-05-01")]["subscription_end_date"] is None
    assert max(m) == d("2025-12-01")  # open-ended runs to the horizon month


def test_empty_and_reversed_ranges_produce_no_months(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account("A6"), account("A7")],
        raw_subscriptions=[
            subscription("S6", "A6", "2026-03-01"),  # after the calendar
            subscription("S7", "A7", "2025-05-10", "2025-03-01", "Cancelled"),  # reversed
        ],
    )
    from revlens.plans.marts import subscription_months

    assert subscription_months(wh).count() == 0
    assert wh.ref("fct_revenue_monthly").count() == 0


def test_retention_30_day_buckets_collide_and_skip(spark):
    monthly = lambda aid, months: [
        invoice(f"{aid}-{m}", f"S{aid}", aid, f"2025-{m:02d}-01", 100) for m in months
    ]
    wh = warehouse(
        spark,
        raw_accounts=[account("J", created="2025-01-01 00:00:00"), account("F", created="2025-02-01 00:00:00")],
        raw_invoices=monthly("J", range(1, 6)) + monthly("F", range(2, 7)),
    )
    r = wh.ref("fct_retention")
    by_cohort = {}
    for x in r.collect():
        by_cohort.setdefault(x["cohort_month"], []).append(x["months_since_cohort"])
    assert sorted(by_cohort[d("2025-01-01")]) == [0, 1, 3, 4]
    assert sorted(by_cohort[d("2025-02-01")]) == [0, 1, 2, 4]
    row = [x for x in r.collect() if x["cohort_month"] == d("2025-01-01") and x["months_since_cohort"] == 1][0]
    assert row["active_accounts"] == 1 and row["cohort_revenue"] == Decimal("200.00")
    assert row["retention_rate"] == Decimal("1.000") and row["churn_rate"] == Decimal("0.000")


def test_activation_null_median_and_unknown_account(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account("A1"), account("A2")],
        raw_subscriptions=[subscription("S1", "A1", "2025-01-01"), subscription("S2", "A2", "2025-01-01")],
        raw_users=[
            ("U1", "A1", "u1@x", "User", "2025-01-01 00:00:00"),
            ("U2", "A1", "u2@x", "User", "2025-01-01 00:00:00"),
            ("U3", "A2", "u3@x", "User", "2025-01-01 00:00:00"),
            ("U9", "ZZ", "u9@x", "User", "2025-01-01 00:00:00"),  # unknown account
        ],
        raw_product_events=[
            ("E1", "U1", "A1", "activation", "2025-01-02 12:00:00"),
            ("E2", "U2", "A1", "activation", "2025-01-04 00:00:00"),
            ("E3", "U2", "A1", "activation", "2025-01-09 00:00:00"),  # later activation ignored
            ("E4", "U3", "A2", "login", "2025-01-02 00:00:00"),
            ("E9", "U9", "ZZ", "activation", "2025-01-02 00:00:00"),
        ],
    )
    got = {x["account_id"]: x for x in wh.ref("fct_activation").collect()}
    assert set(got) == {"A1", "A2"}
    assert got["A1"]["activated_users"] == 2 and got["A1"]["activation_rate"] == Decimal("1.000")
    assert got["A1"]["median_days_to_activate"] == Decimal("2.3")  # median(1.5, 3.0) = 2.25 -> 2.3
    assert got["A2"]["activated_users"] == 0 and got["A2"]["median_days_to_activate"] is None


def test_cac_null_versus_zero(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account("A1", channel="Events")],
        raw_invoices=[invoice("I1", "S1", "A1", "2025-01-01", 300)],
        raw_marketing_spend=[
            ("2025-01-01", "Events", 0.0, 3, "Events Jan 2025"),
            ("2025-01-01", "LinkedIn", 500.0, 9, "LinkedIn Jan 2025"),
        ],
    )
    got = {x["channel"]: x for x in wh.ref("fct_cac_ltv").collect()}
    li = got["LinkedIn"]
    assert li["accounts_acquired"] == 0 and li["total_revenue"] == Decimal("0.00")
    assert li["cac"] is None and li["roas"] is None and li["cac_payback_months"] is None
    ev = got["Events"]
    assert ev["accounts_acquired"] == 1 and ev["cac"] == Decimal("0.00") and ev["roas"] is None
    assert ev["rough_ltv"] == Decimal("300.00") and ev["cac_payback_months"] is None


def test_pct_change_strict_bounds(spark):
    vals = [("m", d("2025-01-01"), "0"), ("m", d("2025-02-01"), "100"), ("m", d("2025-03-01"), "110"),
            ("m", d("2025-04-01"), "132"), ("m", d("2025-05-01"), "105.6"), ("m", d("2025-06-01"), "126.73")]
    df = spark.createDataFrame(vals, "metric_name string, metric_month date, v string").select(
        "metric_name", "metric_month", F.col("v").cast("decimal(38,2)").alias("metric_value")
    )
    out = {x["metric_month"]: x["pct_change"] for x in pct_change(df, "metric_value", ["metric_name"], "metric_month").collect()}
    assert out[d("2025-02-01")] is None  # previous value 0
    assert out[d("2025-03-01")] == Decimal("10.00")
    assert out[d("2025-04-01")] == Decimal("20.00")
    assert out[d("2025-05-01")] == Decimal("-20.00")
    assert out[d("2025-06-01")] == Decimal("20.01")  # 20.0095 rounds half up

    from revlens.plans.model import Warehouse
    from revlens.config import PRODUCT_HORIZON

    fct = df.select(
        F.col("metric_month").alias("revenue_month"), F.lit("A").alias("account_id"),
        F.col("metric_value").alias("mrr"), F.lit(0).cast("decimal(38,2)").alias("churned_mrr"),
        F.lit(0).cast("decimal(38,2)").alias("new_mrr"),
    )
    wh = Warehouse(spark, {}, PRODUCT_HORIZON)
    wh._models["fct_revenue_monthly"] = fct
    an = {(x["metric_name"], x["metric_month"]): x for x in wh.ref("fct_anomalies").collect()}
    mrr = {k[1]: v for k, v in an.items() if k[0] == "MRR"}
    assert d("2025-03-01") not in mrr  # exactly 10 is not an anomaly
    assert mrr[d("2025-04-01")]["anomaly_severity"] == "Moderate Change"
    assert mrr[d("2025-04-01")]["anomaly_type"] == "Normal"  # exactly 20 is not a spike
    assert mrr[d("2025-05-01")]["anomaly_type"] == "Normal"
    assert mrr[d("2025-06-01")]["anomaly_severity"] == "High Change"
    assert mrr[d("2025-06-01")]["anomaly_type"] == "Spike"


def test_dashboard_filters_all_means_no_condition(spark):
    from revlens.config import Filters
    from revlens.plans import dashboard as B

    wh = warehouse(
        spark,
        raw_accounts=[account("A1", segment="SMB", region="EMEA"), account("A2", segment="Enterprise", region="APAC")],
        raw_subscriptions=[subscription("S1", "A1", "2025-01-01"), subscription("S2", "A2", "2025-01-01")],
        raw_invoices=[invoice("I1", "S1", "A1", "2025-01-01", 99), invoice("I2", "S2", "A2", "2025-01-01", 2499)],
    )
    every = B.dash_segment_revenue(wh, Filters(segment="All", region="All", channel="All")).collect()
    assert [(r["segment"], r["total_mrr"]) for r in every] == [("Enterprise", Decimal("2499.00")), ("SMB", Decimal("99.00"))]
    smb = B.dash_segment_revenue(wh, Filters(segment="SMB")).collect()
    assert [r["segment"] for r in smb] == ["SMB"]
    assert B.dash_segment_revenue(wh, Filters(segment="SMB", region="APAC")).count() == 0
    opts = [(r["dimension"], r["position"], r["value"]) for r in B.dash_filter_options(wh).collect()]
    assert ("segment", 0, "All") in opts and ("segment", 1, "Enterprise") in opts and ("segment", 2, "SMB") in opts


def test_invoice_before_cohort_month_gives_negative_bucket(spark):
    from revlens.plans import dashboard as B

    wh = warehouse(
        spark,
        raw_accounts=[account("A", created="2025-03-15 00:00:00")],
        raw_invoices=[invoice("I0", "S", "A", "2025-01-01", 10), invoice("I1", "S", "A", "2025-03-01", 10)],
    )
    buckets = sorted(r["months_since_cohort"] for r in wh.ref("fct_retention").collect())
    assert buckets == [-2, 0]  # floor(-59 / 30) = -2: kept, like the modelled query
    heat = B.dash_cohort_heatmap(wh)
    assert heat.columns == ["cohort_month", *map(str, range(13)), "before"]
    row = heat.first()
    assert row["before"] == {-2: 100} and row["0"] == 100 and row["1"] is None


def test_support_average_is_rounded_once(spark):
    ticket = lambda k, hours: (f"T{k}", "A1", "Billing", "Low", "2025-01-01 00:00:00", None, 48, hours, False)
    wh = warehouse(
        spark,
        raw_accounts=[account("A1")],
        raw_support_tickets=[ticket(1, 10.04), ticket(2, 10.04), ticket(3, 10.09), ticket(4, None)],
    )
    row = wh.ref("fct_support").first()
    assert row["avg_resolution_hours"] == Decimal("10.1") and row["median_resolution_hours"] == Decimal("10.0")


def test_null_segment_has_no_win_rate(spark):
    deal = lambda k, stage, segment: (f"D{k}", None, 100, stage, "2025-01-01", "2025-02-01", 31, segment)
    wh = warehouse(
        spark,
        raw_crm_deals=[deal(1, "Closed Won", None), deal(2, "Closed Lost", None), deal(3, "Closed Won", "SMB"), deal(4, "Lead", "Enterprise")],
    )
    got = {(r["segment"], r["stage"]): (r["win_rate"], r["won_deals"], r["lost_deals"]) for r in wh.ref("fct_pipeline").collect()}
    assert got[None, "Closed Won"] == got[None, "Closed Lost"] == (None, None, None)
    assert got["SMB", "Closed Won"] == (Decimal("1.000"), 1, 0)
    assert got["Enterprise", "Lead"] == (None, None, None)


def test_null_account_joins_no_invoice(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account("A1")],
        raw_subscriptions=[subscription("S1", None, "2025-01-01", "2025-02-28", "Cancelled"), subscription("S2", "A1", "2025-01-01", "2025-01-31")],
        raw_invoices=[invoice("I1", "S1", None, "2025-01-01", 99), invoice("I2", "S2", "A1", "2025-01-01", 50)],
    )
    from revlens.plans.marts import monthly_revenue

    got = {(r["account_id"], r["revenue_month"]): r["mrr"] for r in monthly_revenue(wh).collect()}
    assert got == {(None, d("2025-01-01")): 0, (None, d("2025-02-01")): 0, ("A1", d("2025-01-01")): Decimal("50.00")}
    kept = wh.ref("fct_revenue_monthly").where("account_id is null").collect()
    assert [(r["revenue_month"], r["revenue_type"]) for r in kept] == [(d("2025-02-01"), "churned")]
