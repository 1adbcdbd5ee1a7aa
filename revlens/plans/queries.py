"""Registered queries: staging relations, marts, dashboards, quality checks, sources,
and the building-block operators. Every query reads the test tables under ``sf_dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revlens.config import Filters
from revlens.functions.columns import bucket30, month_start
from revlens.operators.quality import check_relationship, check_unique
from revlens.operators.reshape import cohort_pivot, map_text
from revlens.operators.spine import register_series
from revlens.plans import dashboard as B
from revlens.plans import quality as Q
from revlens.plans.building_blocks import OPERATOR_QUERIES
from revlens.plans.catalog import query, raw_query
from revlens.plans.marts import paid_invoices
from revlens.plans.model import MART_ORDER, Warehouse
from revlens.plans.staging import PROBLEM, STAGING, check_rows, stage
from revlens.session import scratch_dir
from revlens.sources.files import (
    current_version,
    drop_versions,
    load_report,
    observed_report,
    raw_path,
    read_csv,
    read_dirty_csv,
    read_raw,
    text_dates,
    write_table,
)
from revlens.sources.tables import TableCatalog
from revlens.sources.testdata import TestdataRaw


def _model_query(name: str) -> None:
    query(name)(lambda wh: wh.ref(name))


# -- staging relations and marts --------------------------------------------------------
for _name in STAGING:
    _model_query(_name)
for _name in MART_ORDER:
    _model_query(_name)


# -- dashboards ---------------------------------------------------------------------------
query("dash_filter_options")(B.dash_filter_options)
query("dash_kpis")(lambda wh: B.dash_kpis(wh))
query("dash_mrr_trend")(lambda wh: B.dash_mrr_trend(wh))
query("dash_segment_revenue")(lambda wh: B.dash_segment_revenue(wh))
query("dash_win_rate")(B.dash_win_rate)
query("dash_sales_cycle")(B.dash_sales_cycle)
query("dash_deal_value")(B.dash_deal_value)
query("dash_cohort_heatmap")(lambda wh: B.dash_cohort_heatmap(wh).withColumn("before", map_text(F.col("before"))))
query("dash_activation_vs_retention")(lambda wh: B.dash_activation_vs_retention(wh))
query("dash_churn_by_cohort")(lambda wh: B.dash_churn_by_cohort(wh))
query("dash_support_summary")(lambda wh: B.dash_support_summary(wh))
query("dash_tickets_by_segment")(lambda wh: B.dash_tickets_by_segment(wh))
query("dash_sla_by_region")(lambda wh: B.dash_sla_by_region(wh))
query("dash_recent_anomalies")(lambda wh: B.dash_recent_anomalies(wh))
query("dash_anomaly_type_counts")(lambda wh: B.dash_anomaly_type_counts(wh))
query("dash_anomaly_severity_counts")(lambda wh: B.dash_anomaly_severity_counts(wh))
query("dash_metric_trend")(lambda wh: B.dash_metric_trend(wh))
query("dash_metric_choices")(lambda wh: B.dash_metric_choices(wh))
query("dash_chosen_metric_trend")(lambda wh: B.dash_metric_trend(wh, metric="New MRR"))

# Filtered variants (sample selections of the sidebar filters).
FILTERED = {
    "dash_filtered_mrr_trend": (B.dash_mrr_trend, Filters(segment="Enterprise", region="EUROPE")),
    "dash_filtered_kpis": (B.dash_kpis, Filters(segment="Mid-Market", channel="Referral")),
    "dash_filtered_tickets_by_segment": (B.dash_tickets_by_segment, Filters(region="ASIA")),
    "dash_filtered_sla_by_region": (B.dash_sla_by_region, Filters(segment="SMB", channel="LinkedIn")),
    "dash_filtered_segment_revenue": (B.dash_segment_revenue, Filters(region="AMERICA")),
    "dash_filtered_activation_vs_retention": (B.dash_activation_vs_retention, Filters(channel="Events")),
    "dash_filtered_support_summary": (B.dash_support_summary, Filters(segment="Enterprise", region="AFRICA")),
}
for _key, (_fn, _filters) in FILTERED.items():
    query(_key)(lambda wh, _fn=_fn, _filters=_filters: _fn(wh, _filters))

# -- data quality ---------------------------------------------------------------------------
query("dq_generic_summary")(Q.run_checks)
query("dq_unique")(lambda wh: Q.violations(wh, "unique"))
query("dq_not_null")(lambda wh: Q.violations(wh, "not_null"))
query("dq_accepted_values")(lambda wh: Q.violations(wh, "accepted_values"))
query("dq_relationships")(lambda wh: Q.violations(wh, "relationships"))
query("dq_non_negative_amounts")(Q.non_negative_amounts)
query("dq_valid_subscription_dates")(Q.valid_subscription_dates)

# The same operators over rules and tables in which they find something.
query("dq_broken_summary")(lambda wh: Q.run_checks(wh, Q.BROKEN_RULES))
for _kind in ("unique", "not_null", "accepted_values", "relationships"):
    query(f"dq_broken_{_kind}")(lambda wh, _kind=_kind: Q.violations(wh, _kind, Q.BROKEN_RULES))


def damaged(wh: Warehouse) -> Warehouse:
    """The same warehouse over raw tables that break the two assertions: accounts billed below zero,
    subscriptions that end before they start, and some that start after their first invoices."""
    last_digit = F.pmod(F.col("account_id"), F.lit(10))
    amount = F.when(last_digit == 3, -F.col("amount")).otherwise(F.col("amount"))
    turned = (last_digit == 7) & F.col("end_date").isNotNull()
    late = F.when(last_digit == 4, F.date_add(F.col("start_date"), 40)).otherwise(F.col("start_date"))
    dates = {"start_date": F.when(turned, F.col("end_date")).otherwise(late), "end_date": F.when(turned, F.col("start_date")).otherwise(F.col("end_date"))}
    raw = {
        "raw_invoices": wh.raw("raw_invoices").withColumn("amount", amount),
        "raw_subscriptions": wh.raw("raw_subscriptions").withColumns(dates),
    }
    return Warehouse(wh.spark, raw, lambda: wh.horizon)


query("dq_broken_amounts")(lambda wh: Q.non_negative_amounts(damaged(wh)))
query("dq_broken_dates")(lambda wh: Q.valid_subscription_dates(damaged(wh)))


@raw_query("dq_repeated_lines")
def repeated_lines(spark, sf_dir):
    """Line items whose (order, line number) occurs more than once."""
    return check_unique(TestdataRaw(spark, sf_dir).table("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


@raw_query("dq_unlabelled_documents")
def unlabelled_documents(spark, sf_dir):
    """Documents without a row in labels (the referential check across tables)."""
    t = TestdataRaw(spark, sf_dir)
    return check_relationship(t.table("documents"), "documents", "doc_id", t.table("labels"), "doc_id")


@raw_query("dq_negative_balances")
def negative_balances(spark, sf_dir):
    return Q.negative_balances(TestdataRaw(spark, sf_dir).table("customer"))


@raw_query("dq_shipped_before_order")
def shipped_before_order(spark, sf_dir):
    t = TestdataRaw(spark, sf_dir)
    return Q.shipped_before_order(t.table("lineitem"), t.table("orders"))


@query("dq_enforced")
def enforced(wh):
    """Rules that stop a run at severity ``error``, as reported by ``enforce``."""
    try:
        Q.enforce(Q.run_checks(wh, Q.BROKEN_RULES, severity="error"))
    except Q.QualityError as e:
        rows = e.blocking
    else:
        rows = []
    return wh.spark.createDataFrame(
        [(r["model"], r["column"], r["rule"], r["failures"]) for r in rows], "model string, column string, rule string, failures long"
    )


@query("op_anti_join_found")
def anti_join_found(wh):
    """Accounts without a support ticket."""
    a = wh.ref("stg_accounts").select("account_id", "segment")
    t = wh.ref("stg_support_tickets").select(F.col("account_id").alias("_tid"))
    return a.join(t, a["account_id"] == t["_tid"], "left_anti")


@query("sql_segment_mrr")
def sql_segment_mrr(wh):
    """Ad-hoc SQL over registered views, with a bound value."""
    wh.register_views(["fct_revenue_monthly", "dim_account"], prefix="v_")
    return wh.sql(
        """SELECT r.revenue_month, sum(r.mrr) AS total_mrr, count(DISTINCT r.account_id) AS accounts
           FROM v_fct_revenue_monthly r JOIN v_dim_account a ON r.account_id = a.account_id
           WHERE a.segment = :segment GROUP BY r.revenue_month""",
        segment="Mid-Market",
    )


@query("sql_month_series")
def sql_month_series(wh):
    """Subscription months in SQL, by the table function ``month_series``."""
    wh.register_views(["stg_subscriptions"], prefix="m_")
    register_series(wh.spark)
    return wh.sql(
        """SELECT s.account_id, s.subscription_id, m.month AS revenue_month, s.end_date
           FROM m_stg_subscriptions s, LATERAL month_series(
               greatest(trunc(s.start_date, 'MM'), :first),
               least(coalesce(trunc(s.end_date, 'MM'), :open_end), :last)) m""",
        first=wh.horizon.first_month, open_end=wh.horizon.open_end, last=wh.horizon.end,
    )


def _database(spark) -> str:
    """A new database for the tables that a query publishes, below the shared scratch folder."""
    name = f"revlens_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_dir(spark, name)}'")
    return name


@raw_query("sql_published_views")
def sql_published_views(spark, sf_dir):
    """SQL over staging views that another session's warehouse has created."""
    database, other = _database(spark), spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        other.conf.set(key, spark.conf.get(key))
    folder = scratch_dir(spark, "published-raw")
    wh = Warehouse.from_testdata(other, sf_dir)
    wh.load_raw(folder, ["raw_accounts", "raw_subscriptions"], database=database)
    wh.publish_views(TableCatalog(other, database, folder))
    return spark.sql(
        f"""SELECT a.segment, s.plan_tier, count(*) AS subscriptions, min(s.start_date) AS first_start, max(s.end_date) AS last_end
            FROM {database}.stg_subscriptions s JOIN {database}.stg_accounts a ON a.account_id = s.account_id
            GROUP BY a.segment, s.plan_tier"""
    )


@raw_query("src_catalog_rebuild")
def catalog_rebuild(spark, sf_dir):
    """The account dimension by its table name, after it was built twice and old versions were removed."""
    database, folder = _database(spark), scratch_dir(spark, "catalog-rebuild")
    wh = Warehouse.from_testdata(spark, sf_dir)
    for _ in range(2):
        wh.materialize(folder, ["dim_account"], database=database, keep=1)
    return spark.newSession().table(f"{database}.dim_account")


def _built(spark, sf_dir, names, buckets=0):
    """A warehouse whose marts ``names`` are written as tables of a new database."""
    wh = Warehouse.from_testdata(spark, sf_dir)
    database, folder = _database(spark), scratch_dir(spark, "built-marts")
    wh.materialize(folder, names, database=database, buckets=buckets)
    return wh


@raw_query("dash_bucketed_mrr_trend")
def bucketed_mrr_trend(spark, sf_dir):
    """The MRR trend over tables bucketed by account (two buckets: a file each in every month)."""
    return B.dash_mrr_trend(_built(spark, sf_dir, ["dim_account", "fct_revenue_monthly"], buckets=2))


@raw_query("dash_built_kpis")
def built_kpis(spark, sf_dir):
    """The KPI row over written marts: the latest month comes from the partition folders."""
    return B.dash_kpis(_built(spark, sf_dir, ["dim_account", "fct_cac_ltv", "fct_revenue_monthly", "fct_activation"]))


@raw_query("dash_built_segment_revenue")
def built_segment_revenue(spark, sf_dir):
    return B.dash_segment_revenue(_built(spark, sf_dir, ["dim_account", "fct_revenue_monthly"]))


@query("op_pivot_before")
def pivot_before(wh):
    """Paying accounts by 30-day bucket relative to the month in which their subscription ends:
    most cells lie before it."""
    ends = wh.ref("stg_subscriptions").where(F.col("end_date").isNotNull()).select(
        F.col("account_id").alias("_ended"), month_start(F.col("end_date")).alias("cohort_month")
    )
    paid = paid_invoices(wh).select("account_id", month_start(F.col("invoice_date")).alias("month"))
    cells = (
        paid.join(ends, F.col("account_id") == F.col("_ended"))
        .select("cohort_month", "account_id", bucket30(F.col("month"), F.col("cohort_month")).alias("bucket"))
        .distinct()
        .groupBy("cohort_month", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cohort_pivot(cells, "cohort_month", "bucket", F.col("n"), 3).withColumn("before", map_text(F.col("before")))


# -- sources and sinks ----------------------------------------------------------------------
@raw_query("load_observed_counts")
def load_observed_counts(spark, sf_dir):
    """Rows per raw table, observed while they were loaded; nothing is read again."""
    counts: dict[str, int] = {}
    Warehouse.from_testdata(spark, sf_dir).load_raw(
        scratch_dir(spark, "observed-load"), ["raw_accounts", "raw_subscriptions", "raw_support_tickets"], counts=counts
    )
    return observed_report(spark, counts)


@raw_query("src_dirty_export")
def dirty_export(spark, sf_dir):
    """Subscriptions from a CSV export with broken dates and lines cut short: rows that can be
    staged, quarantined rows by the columns that are wrong, and rows read."""
    raw = TestdataRaw(spark, sf_dir).raw_subscriptions()
    key = F.col("subscription_id")
    fields = [F.col(f.name).cast("string") for f in raw.schema]
    fields[3] = F.when(key % 7 == 0, F.lit("2024-13-45")).otherwise(fields[3])
    fields[4] = F.when(F.col("end_date").isNotNull() & (key % 5 == 0), F.lit("soon")).otherwise(fields[4])
    whole = F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])
    path = scratch_dir(spark, "dirty-export")
    raw.select(F.when(key % 11 == 0, F.substring_index(whole, ",", 2)).otherwise(whole).alias("line")).write.text(path)
    checked = check_rows("stg_subscriptions", read_dirty_csv(spark, path, text_dates(raw.schema), header=False))
    columns = F.array_join(F.transform(PROBLEM, lambda p: F.substring_index(p, ":", 1)), ", ")
    problem = F.when(F.size(PROBLEM) == 0, "staged").otherwise(columns)
    counts = checked.groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.unionByName(checked.agg(F.lit("read").alias("problem"), F.count(F.lit(1)).alias("rows")))


@raw_query("src_second_load")
def second_load(spark, sf_dir):
    """Rows per raw table after two loads into one folder, read back from the second."""
    wh = Warehouse.from_testdata(spark, sf_dir)
    folder = scratch_dir(spark, "second-load")
    names = ["raw_accounts", "raw_subscriptions", "raw_marketing_spend"]
    for _ in range(2):
        wh.load_raw(folder, names)
        drop_versions(spark, raw_path(folder, names[0], "parquet"))
    again = Warehouse.from_files(spark, folder, wh.horizon, fmt="parquet")
    return load_report({name: again.raw(name) for name in names})


@raw_query("src_rebuilt_mart")
def rebuilt_mart(spark, sf_dir):
    """The account dimension after it was built twice into one folder."""
    wh = Warehouse.from_testdata(spark, sf_dir)
    folder = scratch_dir(spark, "rebuilt-mart")
    for _ in range(2):
        wh.materialize(folder, ["dim_account"])
    return spark.read.parquet(current_version(spark, f"{folder}/dim_account"))


@raw_query("src_partial_export")
def partial_export(spark, sf_dir):
    """Rows per table of a CSV folder that holds two of the nine files; the others are skipped."""
    raw = TestdataRaw(spark, sf_dir)
    folder = scratch_dir(spark, "partial-export")
    for name in ("raw_users", "raw_marketing_spend"):
        write_table(getattr(raw, name)(), raw_path(folder, name, "csv"), fmt="csv")
    return load_report(read_raw(spark, folder))


@raw_query("src_csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """Support tickets exported as headered CSV, read back with an explicit schema, staged.

    Exercises the CSV sink (overwrite), the typed CSV source and the staging casts of
    booleans, doubles and microsecond timestamps. The export is written when the query is
    built, into a fresh folder below the shared checkpoint directory, as the returned
    frame reads it.
    """
    raw = TestdataRaw(spark, sf_dir).raw_support_tickets()
    path = scratch_dir(spark, "csv-roundtrip")
    write_table(raw, path, fmt="csv")
    back = read_csv(spark, path, text_dates(raw.schema))
    return stage("stg_support_tickets", back)


@raw_query("load_row_counts")
def load_row_counts(spark, sf_dir):
    """Rows per raw table and in total (the load report)."""
    raw = TestdataRaw(spark, sf_dir).all()
    return load_report({name: raw[name] for name in raw})


# -- building blocks ------------------------------------------------------------------------
for _key, _fn in OPERATOR_QUERIES.items():
    query(_key)(_fn)
