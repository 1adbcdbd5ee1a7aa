"""Raw CSV export -> typed reload -> marts; ad-hoc SQL with bound parameters."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from revlens.config import TESTDATA_HORIZON
from revlens.plans.model import Warehouse
from revlens.sources.files import load_report, write_table
from revlens.sources.schemas import RAW_FILES

SF = "/root/testdata/sf0.001"


def test_csv_load_path_rebuilds_the_same_mart(spark):
    direct = Warehouse.from_testdata(spark, SF)
    folder = tempfile.mkdtemp(prefix="revlens-raw-")
    for name, file in RAW_FILES.items():
        write_table(direct.raw(name), f"{folder}/{file}", fmt="csv")
    loaded = Warehouse.from_files(spark, folder, TESTDATA_HORIZON)
    assert sorted(loaded.raw_tables) == sorted(RAW_FILES)
    counts = {r["table"]: r["rows"] for r in load_report(loaded.raw_tables).collect()}
    assert counts["total"] == sum(v for k, v in counts.items() if k != "total")

    cols = ["account_id", "revenue_month", "mrr", "revenue_type", "nrr"]
    a = direct.ref("fct_revenue_monthly").select(F.col("account_id").cast("string"), *cols[1:])
    b = loaded.ref("fct_revenue_monthly").select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ad_hoc_sql_with_bound_parameters(spark):
    wh = Warehouse.from_testdata(spark, SF)
    wh.register_views(["fct_revenue_monthly", "dim_account"], prefix="t_")
    df = wh.sql(
        """SELECT r.revenue_month, SUM(r.mrr) AS total_mrr
           FROM t_fct_revenue_monthly r JOIN t_dim_account da ON r.account_id = da.account_id
           WHERE da.segment = :segment GROUP BY 1""",
        segment="SMB' OR '1'='1",  # a quote in a value cannot change the query
    )
    assert df.count() == 0
    ok = wh.sql("SELECT COUNT(*) AS n FROM t_dim_account WHERE segment = :segment", segment="SMB")
    assert ok.first()["n"] > 0


def test_materialized_marts_answer_like_the_lazy_chain(spark):
    from revlens.operators.reshape import map_text
    from revlens.plans import dashboard as B
    from revlens.plans.catalog import as_result
    from revlens.plans.model import MART_ORDER
    from revlens.session import scratch_dir

    lazy = Warehouse.from_testdata(spark, SF)
    built = Warehouse.from_testdata(spark, SF)
    paths = built.materialize(scratch_dir(spark, "test-marts"), MART_ORDER)
    assert set(paths) == set(MART_ORDER)
    # the month-partitioned mart prunes a latest-month filter to one directory
    plan = built.ref("fct_revenue_monthly").where(F.col("revenue_month") == "2001-08-01")._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(revenue_month" in plan.executedPlan().toString()
    for fn in (B.dash_kpis, B.dash_mrr_trend, B.dash_sla_by_region, B.dash_cohort_heatmap, B.dash_recent_anomalies):
        a, b = as_result(fn(lazy)), as_result(fn(built))
        if "before" in a.columns:  # maps cannot be compared as sets
            a, b = (x.withColumn("before", map_text(F.col("before"))) for x in (a, b))
        assert sorted(a.columns) == sorted(b.columns)
        b = b.select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_loaded_raw_tables_give_the_same_marts(spark):
    from revlens.session import scratch_dir

    direct = Warehouse.from_testdata(spark, SF)
    loaded = Warehouse.from_testdata(spark, SF)
    loaded.load_raw(scratch_dir(spark, "test-raw"))
    for name in ("fct_retention", "fct_cac_ltv", "fct_support"):
        a, b = direct.ref(name), loaded.ref(name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_loaded_parquet_folder_reopens(spark):
    from revlens.session import scratch_dir

    folder = scratch_dir(spark, "test-raw-reopen")
    first = Warehouse.from_testdata(spark, SF)
    first.load_raw(folder)
    again = Warehouse.from_files(spark, folder, TESTDATA_HORIZON, fmt="parquet")
    a, b = first.ref("fct_revenue_monthly"), again.ref("fct_revenue_monthly")
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rebuilds_see_changed_input_and_survive(spark):
    from helpers import account, raw_frames, subscription
    from revlens.config import PRODUCT_HORIZON
    from revlens.session import scratch_dir
    from revlens.sources.files import current_version, drop_versions, raw_path

    folder = scratch_dir(spark, "test-rebuild")
    tables = {"raw_accounts": [account("A1")], "raw_subscriptions": [subscription("S1", "A1", "2025-01-01")]}
    wh = Warehouse(spark, lambda: raw_frames(spark, **tables), PRODUCT_HORIZON)
    for n in (1, 2, 3):
        wh.load_raw(f"{folder}/raw")
        assert wh.raw("raw_accounts").count() == n
        wh.materialize(folder, ["dim_account", "dim_date"])
        wh.materialize(folder, ["dim_account"])  # again, in the same session and folder
        assert wh.ref("dim_account").count() == n
        again = Warehouse.from_files(spark, f"{folder}/raw", PRODUCT_HORIZON, fmt="parquet")
        assert again.ref("stg_accounts").count() == n
        tables["raw_accounts"].append(account(f"A{n + 1}"))
    path = raw_path(f"{folder}/raw", "raw_accounts", "parquet")
    newest = current_version(spark, path)
    assert drop_versions(spark, path) == 2 and current_version(spark, path) == newest
    assert spark.read.parquet(newest).count() == 3


def test_failed_write_leaves_the_table_as_it_was(spark):
    import pytest

    from revlens.session import scratch_dir
    from revlens.sources.files import current_version, write_version

    path = scratch_dir(spark, "test-failed")
    first = write_version(spark.range(3), path)
    with pytest.raises(Exception):
        write_version(spark.range(5).select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert current_version(spark, path) == first and spark.read.parquet(first).count() == 3
