"""Named tables, permanent views, statistics, buckets, dirty rows, observed counts, deferred steps."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from pathlib import Path

import pytest
from helpers import account, raw_frames, subscription
from pyspark.sql import functions as F

from revlens.config import PRODUCT_HORIZON, TESTDATA_HORIZON
from revlens.plans.model import Warehouse
from revlens.plans.staging import PROBLEM, check_rows, stage_clean
from revlens.session import scratch_dir
from revlens.sources.files import observed_report, read_dirty_csv, text_dates
from revlens.sources.schemas import RAW_SCHEMAS
from revlens.sources.tables import Layout, TableCatalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def database(spark):
    name = f"t_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_dir(spark, name)}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


@contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def built(spark):
    """Marts of the test tables as bucketed tables, in a database of their own."""
    name, folder = f"t_{uuid.uuid4().hex[:10]}", scratch_dir(spark, "test-built")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_dir(spark, name)}'")
    wh = Warehouse.from_testdata(spark, SF, TESTDATA_HORIZON)
    wh.load_raw(f"{folder}/raw", ["raw_accounts", "raw_subscriptions"], database=name)
    wh.materialize(folder, ["dim_account", "fct_cac_ltv", "fct_revenue_monthly", "fct_activation", "fct_support"], database=name, buckets=2)
    yield wh, name, folder
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_a_failed_rebuild_leaves_the_old_rows(spark, database):
    tables = {"raw_accounts": [account("A1")], "raw_subscriptions": [subscription("S1", "A1", "2025-01-01")]}
    folder = scratch_dir(spark, "test-catalog")
    wh = Warehouse(spark, lambda: raw_frames(spark, **tables), PRODUCT_HORIZON)
    other = spark.newSession()
    for n in (1, 2):
        wh.load_raw(f"{folder}/raw", database=database)
        wh.materialize(folder, ["dim_account"], database=database)
        assert other.table(f"{database}.dim_account").count() == other.table(f"{database}.raw_accounts").count() == n
        tables["raw_accounts"].append(account(f"A{n + 1}"))
    catalog = TableCatalog(spark, database, folder)
    reader = other.table(f"{database}.dim_account")
    with pytest.raises(Exception, match="stop"):
        catalog.publish(spark.range(5).select(F.raise_error(F.lit("stop")).alias("x")), "dim_account")
    assert other.table(f"{database}.dim_account").count() == 2
    wh.load_raw(f"{folder}/raw", database=database, keep=1)
    wh.materialize(folder, ["dim_account"], database=database)
    assert reader.count() == 2 and other.table(f"{database}.dim_account").count() == 3  # a reader keeps its version
    assert catalog.drop_old("dim_account") == 3  # two whole ones and what the failed build left
    assert other.table(f"{database}.dim_account").count() == 3
    assert len([t for t in spark.catalog.listTables(database) if t.name.startswith("raw_accounts__v")]) == 1


def test_another_application_attaches_the_folder(spark, built, database):
    wh, _, folder = built
    again = Warehouse.from_catalog(spark, folder, database, TESTDATA_HORIZON)  # a database that knows no table
    for name in ("dim_account", "fct_support", "fct_revenue_monthly"):
        a, b = wh.ref(name), again.ref(name)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    text = spark.sql(f"SHOW CREATE TABLE {database}.{version(spark, database, 'fct_revenue_monthly')}").first()[0]
    assert "PARTITIONED BY (revenue_month)" in text and "INTO 2 BUCKETS" in text
    assert spark.newSession().table(f"{database}.stg_accounts").count() == wh.ref("stg_accounts").count()
    assert again.ref("stg_subscriptions").exceptAll(wh.ref("stg_subscriptions")).count() == 0


def version(spark, database, table):
    return max(t.name for t in spark.catalog.listTables(database) if t.name.startswith(f"{table}__v"))


def test_staging_views_equal_the_staging_frames(spark, database):
    from revlens.sources.schemas import RAW_TABLES

    folder = scratch_dir(spark, "test-views")
    wh = Warehouse.from_testdata(spark.newSession(), SF, TESTDATA_HORIZON)
    wh.load_raw(folder, database=database)
    assert len(wh.publish_views(TableCatalog(wh.spark, database, folder))) == len(RAW_TABLES)
    del wh
    frames = Warehouse.from_testdata(spark, SF, TESTDATA_HORIZON)
    for name in ("stg_accounts", "stg_invoices", "stg_support_tickets", "stg_marketing_spend"):
        a, b = frames.ref(name), spark.table(f"{database}.{name}")
        assert a.dtypes == b.dtypes and a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_views_over_text_refuse_finer_amounts(spark, database):
    from revlens.plans.staging import staging_sql

    spark.createDataFrame([("I1", "S", "A", "2025-01-01", 10.25, "Paid"), ("I2", "S", "A", "2025-01-01", 1.005, "Paid")],
                          RAW_SCHEMAS["raw_invoices"]).createOrReplaceTempView("finer")
    rows = spark.sql(staging_sql("stg_invoices", RAW_SCHEMAS["raw_invoices"], "finer"))
    assert rows.where("invoice_id = 'I1'").first()["invoice_date"].isoformat() == "2025-01-01"
    with pytest.raises(Exception, match="amount finer than a cent"):
        rows.collect()


def test_bucketed_tables_join_without_a_shuffle(spark, built):
    from revlens.plans import dashboard as B

    wh, _, _ = built
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        for fn in (B.dash_mrr_trend, B.dash_sla_by_region, B.dash_tickets_by_segment):
            lines = plan_of(fn(wh)).split("\n")
            at = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
            assert not any("Exchange" in line for line in lines[at:]), "\n".join(lines)
            assert any("Bucketed: true" in line for line in lines)


def test_statistics_decide_what_is_broadcast(spark, built):
    wh, database, _ = built
    small, large = wh.ref("fct_cac_ltv"), wh.ref("fct_revenue_monthly")
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size(small) < 10_000 < size(large)
    column = spark.sql(f"DESCRIBE EXTENDED {database}.{version(spark, database, 'fct_support')} account_id").collect()
    assert int({r["info_name"]: r["info_value"] for r in column}["distinct_count"]) > 0
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="10000", spark__sql__adaptive__enabled="false"):
        r = large.select("account_id", F.col("revenue_type").alias("t"))
        assert "BroadcastHashJoin" in plan_of(r.join(small, r["t"] == small["channel"]))
        again = large.select(F.col("account_id").alias("a"), F.col("mrr").alias("m"))
        assert "BroadcastHashJoin" not in plan_of(r.join(again, r["account_id"] == again["a"]))


def test_latest_month_is_read_off_the_partitions(spark, built):
    from revlens.plans import dashboard as B

    wh, _, _ = built
    last = wh.ref("fct_revenue_monthly").agg(F.max("revenue_month")).first()[0]
    for fn in (B.dash_segment_revenue, B.dash_kpis):
        text = fn(wh)._jdf.queryExecution().toString()
        scans = [line for line in text.split("== Physical Plan ==")[1].split("\n") if "FileScan" in line and "revenue_month" in line]
        assert len(scans) == 1 and f"(revenue_month#" in scans[0] and f"= {last}" in scans[0], scans
    lazy = Warehouse.from_testdata(spark, SF, TESTDATA_HORIZON)
    a, b = B.dash_segment_revenue(lazy).collect(), B.dash_segment_revenue(wh).collect()
    assert a == b


def test_naming_models_runs_nothing(spark):
    sc = spark.sparkContext
    sc.setJobGroup("naming", "models are named only")
    try:
        wh = Warehouse.from_testdata(spark, SF, TESTDATA_HORIZON)
        wh.register_views(prefix="n_")
        assert list(sc.statusTracker().getJobIdsForGroup("naming")) == []
        assert wh.sql("SELECT count(*) FROM n_dim_date").first()[0] > 0
        assert list(sc.statusTracker().getJobIdsForGroup("naming")) != []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    lazy = wh.ref("fct_support")
    wh.materialize(scratch_dir(spark, "test-step"), ["dim_account", "fct_support"])
    assert wh.step is None
    assert lazy.exceptAll(wh.ref("fct_support")).count() == 0 and lazy.count() == wh.ref("fct_support").count()


def test_month_series_has_no_join(spark):
    from revlens.operators.spine import register_series

    register_series(spark)
    spark.createDataFrame([(1, "2025-01-01", "2025-03-01"), (2, "2025-03-01", "2025-01-01"), (3, None, "2025-01-01")], "k int, a string, b string")\
        .selectExpr("k", "date(a) a", "date(b) b").createOrReplaceTempView("spans")
    df = spark.sql("SELECT s.k, m.month FROM spans s, LATERAL month_series(s.a, s.b) m")
    assert "Join" not in plan_of(df) and "Generate" in plan_of(df)
    assert [(r[0], r[1].month) for r in df.orderBy("k", "month").collect()] == [(1, 1), (1, 2), (1, 3)]
    assert spark.sql("SELECT * FROM day_series(DATE'2024-02-27', DATE'2024-03-02')").count() == 5


def test_dirty_lines_go_to_the_quarantine(spark, tmp_path):
    schema = text_dates(RAW_SCHEMAS["raw_invoices"])
    lines = [
        "invoice_id,subscription_id,account_id,invoice_date,amount,status",
        "I1,S1,A1,2025-01-01,10.5,Paid",
        "I2,S1,A1,2025-13-01,10.5,Paid",  # no such month
        "I3,S1",  # a short line
        "I4,S1,A1,2025-01-01,ten,Paid",  # not a number
        "I5,S1,A1,2025-01-01,1.005,Paid",  # finer than a cent
        "I6,S1,A1,,10,Paid",  # a missing date is null, not a problem
        "I7,S1,A1,yesterday,1.005,Paid",  # two problems
    ]
    (tmp_path / "invoices.csv").write_text("\n".join(lines) + "\n")
    raw = read_dirty_csv(spark, str(tmp_path / "invoices.csv"), schema)
    good, bad = stage_clean("stg_invoices", raw)
    assert sorted(r["invoice_id"] for r in good.collect()) == ["I1", "I6"]
    found = {re.search(r'"invoice_id":"(\w+)"', r["record"])[1]: r[PROBLEM] for r in bad.collect()}
    assert found["I2"] == ["invoice_date: not a date: 2025-13-01"]
    assert found["I3"] == ["unreadable line: I3,S1"]
    assert found["I4"] == ["unreadable line: I4,S1,A1,2025-01-01,ten,Paid"]
    assert found["I5"] == ["amount: finer than a cent: 1.005"]
    assert len(found["I7"]) == 2
    assert good.count() + bad.count() == len(lines) - 1
    assert good.dtypes == Warehouse(spark, raw_frames(spark), PRODUCT_HORIZON).ref("stg_invoices").dtypes
    clean = spark.createDataFrame([("I1", "S", "A", "2025-01-01", 1.0, "Paid")], RAW_SCHEMAS["raw_invoices"])
    assert check_rows("stg_invoices", clean).first()[PROBLEM] == []


def test_counts_are_observed_during_the_load(spark, database):
    folder, counts = scratch_dir(spark, "test-observed"), {}
    tables = {"raw_accounts": [account(f"A{k}") for k in range(7)], "raw_subscriptions": [subscription("S1", "A1", "2025-01-01")]}
    wh = Warehouse(spark, lambda: raw_frames(spark, **tables), PRODUCT_HORIZON)
    for kwargs in ({}, {"database": database}):
        counts.clear()
        wh.load_raw(folder, counts=counts, **kwargs)
        assert counts["raw_accounts"] == 7 and counts["raw_subscriptions"] == 1 and counts["raw_users"] == 0
        assert {r["table"]: r["rows"] for r in observed_report(spark, counts).collect()}["total"] == 8


def test_layout_of_a_table_without_statistics(spark, database):
    catalog = TableCatalog(spark, database, scratch_dir(spark, "test-layout"))
    catalog.publish(spark.range(10).withColumn("k", F.col("id") % 2), "t", Layout(("k",)), analyze=False)
    assert catalog.table("t").where("k = 1").count() == 5 and "k=1" in catalog.folder_of("t") + "/k=1"
    assert catalog.table("t").columns == ["id", "k"]


def test_bucketed_partitions_are_written_by_many_tasks(spark, database, tmp_path):
    """A file for each partition and bucket, and no task that writes a whole bucket of the table."""
    catalog = TableCatalog(spark, database, str(tmp_path))
    rows = spark.range(600).withColumn("k", F.col("id") % 12)
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        path = catalog.publish(rows, "t", Layout(("k",), ("id",), 2), analyze=False)
    files = [(f.parent.name, f.name) for f in Path(path).glob("k=*/*.parquet")]
    assert len(files) == 24
    assert len({re.match(r"part-(\d+)", name)[1] for _, name in files}) > 2
    back = spark.table(f"{database}.t")
    assert sorted(r["id"] for r in back.collect()) == list(range(600))
