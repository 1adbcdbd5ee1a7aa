"""Invariants of the marts on the smallest test tables (whole tables, no sampling)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.plans import marts as M
from revlens.plans.model import Warehouse

SF = "/root/testdata/sf0.001"


def test_movements_add_up_to_monthly_revenue(spark):
    """Over the unfiltered account-months, the signed changes sum to the last month's mrr."""
    wh = Warehouse.from_testdata(spark, SF)
    lag = M.revenue_with_lag(wh)
    mrr, prev = F.col("mrr"), F.col("prev_mrr")
    signed = F.when(prev.isNull(), mrr).otherwise(mrr - prev)
    per_account = lag.groupBy("account_id").agg(
        F.sum(signed).alias("net"), F.max_by("mrr", "revenue_month").alias("last")
    )
    assert per_account.where(F.col("net") != F.col("last")).count() == 0


def test_retention_plus_churn_is_one_and_rates_bounded(spark):
    r = Warehouse.from_testdata(spark, SF).ref("fct_retention")
    bad = r.where((F.col("retention_rate") + F.col("churn_rate") != 1) | (F.col("active_accounts") > F.col("cohort_size")))
    assert bad.count() == 0


def test_won_plus_lost_at_most_deals(spark):
    wh = Warehouse.from_testdata(spark, SF)
    p = wh.ref("fct_pipeline")
    per_segment = p.groupBy("segment").agg(
        F.sum("deal_count").alias("deals"), F.max("won_deals").alias("won"), F.max("lost_deals").alias("lost")
    )
    assert per_segment.where(F.col("won") + F.col("lost") > F.col("deals")).count() == 0


def test_revenue_types_and_filter(spark):
    r = Warehouse.from_testdata(spark, SF).ref("fct_revenue_monthly")
    types = {x["revenue_type"] for x in r.select("revenue_type").distinct().collect()}
    assert types <= {"new", "expansion", "contraction", "churned", "maintained"}
    assert r.where((F.col("mrr") <= 0) & (F.col("revenue_type") != "churned")).count() == 0
