"""Operators against brute force on small inputs, and plan-shape checks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.config import TESTDATA_HORIZON
from revlens.operators.median import exact_median
from revlens.operators.spine import deal_out
from revlens.session import scratch_dir


def written(df, name):
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed,in_task", [(1, 100_000), (2, 0), (3, 5), (5, None), (6, None)])
def test_exact_median_matches_numpy(spark, seed, in_task):
    """With a written histogram, its keys large or small, and (None) as a plan."""
    rnd = random.Random(seed)
    data = []
    for k in range(6):
        n = rnd.randint(1, 40)
        vals = [round(rnd.uniform(0, 10), 1) if rnd.random() > 0.1 else None for _ in range(n)]
        vals += [vals[0]] * rnd.randint(0, 5)  # duplicates
        if k == 5:
            vals += [1e6] * 3 + [-1e9]  # far outliers: most values share one first-level bin
        data += [(k if k != 4 else None, v) for v in vals]
    df = spark.createDataFrame(data, "k int, v double")
    found = exact_median(df, ["k"], "v") if in_task is None else exact_median(df, ["k"], "v", in_task=in_task, written=written)
    got = {r["k"]: r["median"] for r in found.collect()}
    for k in range(6):
        if k == 4:
            k = None
        vals = [v for kk, v in data if kk == k and v is not None]
        if not vals:
            assert k not in got
        else:
            assert got[k] == pytest.approx(float(np.median(vals)), abs=1e-12)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_revenue_plan_has_no_nested_loop_and_one_window(spark):
    from revlens.plans.model import Warehouse

    df = Warehouse.from_testdata(spark, SF).ref("fct_revenue_monthly")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("Window [") == 1
    assert "Generate explode" in plan


def test_filters_and_columns_reach_the_scan(spark):
    from revlens.plans.model import Warehouse

    wh = Warehouse.from_testdata(spark, SF)
    df = wh.ref("stg_product_events").where(F.col("event_type") == "activation").select("user_id")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan


def test_no_nested_loops_cartesian_or_python_in_any_plan(spark):
    import contextlib
    import io

    from revlens.plans.catalog import all_queries

    offenders = []
    for key, fn in sorted(all_queries().items()):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, SF).explain("formatted")
        text = buf.getvalue()
        hits = [w for w in ("NestedLoop", "Cartesian", "PythonUDF", "EvalPython") if w in text]
        if hits:
            offenders.append((key, hits))
    assert offenders == []


def test_hot_key_median_and_duplicates_match_brute_force(spark):
    """One key holds a third of the rows (with a heavy tail); results stay exact."""
    from revlens.operators.quality import check_unique

    rnd = random.Random(7)
    rows = [(0, rnd.expovariate(0.1)) for _ in range(4000)] + [(0, 1e7)]  # hot key, far outlier
    rows += [(k % 400 + 1, rnd.uniform(0, 50)) for k in range(8000)]
    df = spark.createDataFrame(rows, "k int, v double")
    by_key = {}
    for k, v in rows:
        by_key.setdefault(k, []).append(v)
    for found in (exact_median(df, ["k"], "v"), exact_median(df, ["k"], "v", in_task=1000, written=written)):
        got = {r["k"]: r["median"] for r in found.collect()}
        for k, vals in by_key.items():
            assert got[k] == pytest.approx(float(np.median(vals)), rel=0, abs=1e-9)
    dup = {r["value"]: r["rows"] for r in check_unique(df, "t", "k").collect()}
    assert dup["0"] == 4001 and len(dup) == 401


def test_outlier_cannot_crowd_the_digits_of_a_median(spark):
    """100,001 distinct values beside one at 1e12: no running count sees more than 65,536 digits."""
    from revlens.operators import median

    df = spark.range(100_001).select(F.lit(1).alias("k"), F.rand(3).alias("v")).union(spark.sql("SELECT 1, 1e12D"))
    kept = []
    got = exact_median(df, ["k"], "v", in_task=1000, written=lambda d, name: kept.append((name, written(d, name))) or kept[-1][1]).collect()
    vals = sorted(r["v"] for r in df.collect())
    assert got[0]["median"] == vals[50_000] + (vals[50_001] - vals[50_000]) * 0.5
    digits = [f"_d{i}" for i in range(median.DIGITS)]
    rounds = [d for name, d in kept if name == "median-digits"]
    for i, left in enumerate(rounds[:-1]):  # rows that the next running count reads per group
        cells = left.groupBy("k", *digits[: i + 1]).agg(F.countDistinct(digits[i + 1]).alias("n")).agg(F.max("n")).first()[0]
        assert cells <= 1 << median.DIGIT_BITS
    assert rounds[-1].groupBy("k", *digits).count().agg(F.max("count")).first()[0] == 1


def test_quantiles_fold_what_lies_outside_them(spark):
    """200,000 distinct values in one key: the running counts of the plan see a few hundred."""
    from revlens.operators import median

    df = spark.range(200_000).select(F.lit(1).alias("k"), F.exp(F.rand(3) * 100).alias("v"))
    vals = sorted(r["v"] for r in df.collect())
    assert exact_median(df, ["k"], "v").first()["median"] == vals[99_999] + (vals[100_000] - vals[99_999]) * 0.5
    share = [0.5 - 5 / median.ACCURACY, 0.5 + 5 / median.ACCURACY]
    low, high = df.agg(F.percentile_approx("v", share, median.ACCURACY)).first()[0]
    assert df.where(F.col("v").between(low, high)).count() < 400


def test_ordered_bits_order_like_the_values(spark):
    from revlens.operators.median import ordered_bits

    vals = [-1e308, -5.5, -1e-320, 0.0, 5e-324, 1e-320, 2.0, 2.0000000000000004, 1e300, float("inf"), float("-inf")]
    vals += [x for e in range(-1074, 1024, 7) for x in (2.0**e, 2.0**e * 1.9999999999999998, -(2.0**e))]
    vals = sorted(set(vals))
    df = spark.createDataFrame([(v,) for v in vals], "v double").withColumn("b", ordered_bits(F.col("v")))
    assert [r["v"] for r in df.orderBy("b").collect()] == sorted(vals)


def test_scale_plans(spark):
    """No fixed-count repartition; the child is counted before the anti join; nothing is stored for a plan."""
    from revlens.operators.quality import check_relationship
    from revlens.plans.model import Warehouse

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wh = Warehouse.from_testdata(spark, SF)
        for name in ("fct_revenue_monthly", "stg_invoices", "fct_cac_ltv"):
            plan = wh.ref(name)._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" not in plan and "RoundRobin" not in plan
        child, parent = wh.ref("stg_users"), wh.ref("stg_accounts")
        plan = check_relationship(child, "u", "account_id", parent, "account_id")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftAnti") < plan.index("Aggregate [account_id")
        plan = wh.ref("fct_support")._jdf.queryExecution().executedPlan().toString()
        assert "median-histogram" not in plan and "percentile_approx" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from revlens.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def test_expanded_months_keep_their_tasks(spark):
    from revlens.config import TESTDATA_HORIZON
    from revlens.plans import building_blocks as BB
    from revlens.plans import marts as M
    from revlens.plans.model import Warehouse

    horizon = TESTDATA_HORIZON
    assert horizon.months == 84
    wh = Warehouse.from_testdata(spark, "/root/testdata/sf0.001", horizon)
    # few bytes before they expand: adaptive execution would merge them, in a union to one task
    assert M.subscription_months(wh).rdd.getNumPartitions() == 84
    assert wh.ref("stg_invoices").rdd.getNumPartitions() == 84
    assert M.revenue_with_lag(wh).rdd.getNumPartitions() == 84
    assert BB.op_union_all(wh).rdd.getNumPartitions() >= 84


@pytest.mark.parametrize("shuffles,initial,tasks", [("8", None, 84), ("84", None, 168), ("100", None, 200), ("100", "200", 201), ("8", "84", 85)])
def test_dealt_out_rows_stay_in_a_set_number_of_tasks(spark, shuffles, initial, tasks):
    """Also where the rows lie by the same key in as many partitions: these could be merged."""
    keys = {"spark.sql.shuffle.partitions": shuffles, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": initial}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            _ = spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        by_account = spark.range(500).selectExpr("id % 50 AS account_id").groupBy("account_id").count()
        dealt = deal_out(by_account, "account_id", TESTDATA_HORIZON)
        assert dealt.rdd.getNumPartitions() == tasks
        assert sorted(r["account_id"] for r in dealt.collect()) == list(range(50))
    finally:
        for k, v in old.items():
            _ = spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_months_in_a_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """The tasks that expand months follow the accounts of the orders, on both sides of the revenue union."""
    from revlens.operators import spine
    from revlens.plans import marts as M
    from revlens.plans.model import Warehouse

    rows = "id, id % 200 AS o_custkey, 'F' AS o_orderstatus, 10.0D AS o_totalprice, '1-URGENT' AS o_orderpriority"
    day = "CAST(date_add(DATE'2000-01-01', CAST(id % 700 AS INT)) AS timestamp_ntz)"
    spark.range(2000).selectExpr(*rows.split(", "), f"{day} AS o_orderdate").withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(200).selectExpr(
        "id AS c_custkey", "'c' AS c_name", "0 AS c_nationkey", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 0 AS r_regionkey, 'r' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(5).selectExpr("id AS l_orderkey", "CAST(DATE'2001-01-01' AS timestamp_ntz) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    wh = Warehouse.from_testdata(spark, str(tmp_path))
    assert wh.horizon.months == 24 and 160 <= wh.horizon.accounts <= 240
    whole = sorted(map(tuple, M.revenue_with_lag(wh).collect()), key=str)
    assert M.subscription_months(wh).rdd.getNumPartitions() == 24

    monkeypatch.setattr(spine, "MONTHS_IN_TASK", 48)
    tasks = -(-wh.horizon.accounts // 2)
    again = Warehouse.from_testdata(spark, str(tmp_path))
    assert M.subscription_months(again).rdd.getNumPartitions() == tasks > 24
    assert again.ref("stg_invoices").rdd.getNumPartitions() == tasks
    assert M.revenue_with_lag(again).rdd.getNumPartitions() == tasks  # neither side is dealt anew
    assert sorted(map(tuple, M.revenue_with_lag(again).collect()), key=str) == whole


def test_customers_are_read_by_their_own_tasks(spark, tmp_path):
    """The nations are broadcast to the customers also when adaptive execution plans anew, never the customers to the one task of the nations."""
    from revlens.sources.testdata import TestdataRaw

    spark.range(3000).selectExpr(
        "id AS o_orderkey", "id % 900 AS o_custkey", "'F' AS o_orderstatus", "10.0D AS o_totalprice",
        "CAST(date_add(DATE'2000-01-01', CAST(id % 700 AS INT)) AS timestamp_ntz) AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, 1000, 1, 4).selectExpr(
        "id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 30 AS INT) AS c_nationkey", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 25, 1, 1).selectExpr(
        "CAST(id AS INT) AS n_nationkey", "concat('n', id) AS n_name", "CAST(id % 5 AS INT) AS n_regionkey"
    ).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(0, 5, 1, 1).selectExpr("CAST(id AS INT) AS r_regionkey", "concat('r', id) AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    raw = TestdataRaw(spark, str(tmp_path))
    for df, rows in ((raw.raw_subscriptions(), 750), (raw.raw_accounts(), 750), (raw.raw_crm_deals(), 2500)):
        assert len(df.collect()) == rows
        joins = [line for line in plan_text(df).partition("Initial Plan")[0].splitlines() if "c_nationkey" in line and "Join [" in line]
        assert joins and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)
