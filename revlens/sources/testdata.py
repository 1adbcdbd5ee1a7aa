"""The nine raw shapes derived from the TPC-H-like test tables.

Plain column arithmetic over whole tables, so every raw shape grows with the input:

* accounts       customer x nation x region x first order of the customer
* users          events grouped by user
* subscriptions  one per account, ended for some accounts at their last order
* invoices       subscriptions expanded to one row per billed month
* payments       paid invoices
* crm_deals      orders x customer
* product_events non-error events, renamed event types
* support_tickets error events with deterministic severities and SLA outcomes
* marketing_spend lineitem revenue by ship month and supplier bucket

Plan shape: ``orders`` is aggregated once per customer (first and last order date,
partial aggregation before the shuffle). ``nation``/``region`` are the fixed-size
dimension tables of the benchmark schema (25 and 5 rows). A hint broadcasts them: adaptive
execution takes their join for large once it has run half of it, and would broadcast the
customers instead, whose rows one task (that of the nations) then makes. Invoices come
from a ``Generate`` over ``sequence`` (no join with a calendar). Nothing here collects to the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.config import TESTDATA_HORIZON, Horizon
from revlens.functions.columns import pick
from revlens.operators.spine import deal_out
from revlens.sources.schemas import RAW_TABLES
from revlens.sources.values import (
    MARKETING_CHANNELS,
    PAYMENT_METHODS,
    PLAN_TIERS,
    SUPPORT_CATEGORIES,
)

# Fixed rules of the test-table derivation (see FIXTURES.md, part B).
PLAN_PRICES = [99, 299, 799, 2499]  # per PLAN_TIERS position
SURGE_PRICES = [float(p * Decimal("1.2")) for p in PLAN_PRICES]
TEST_CHANNELS = MARKETING_CHANNELS + ["Partner"]  # bucket 5 has spend but no accounts
OPEN_STAGES_BY_PRIORITY = ["Negotiation", "Proposal", "SQL", "MQL", "Lead"]
SLA_HOURS = {"Low": 48, "Medium": 24, "High": 8, "Critical": 2}

# Declared schemas of the test tables that are read (skips footer-based inference).
TEST_TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def segment_of(mktsegment: Column) -> Column:
    return (
        F.when(mktsegment == "BUILDING", "Enterprise")
        .when(mktsegment.isin("MACHINERY", "AUTOMOBILE"), "Mid-Market")
        .otherwise("SMB")
    )


def _div(c: Column, n: int) -> Column:
    """Integer division of a non-negative integral column."""
    return F.floor(c / F.lit(n)).cast("long")


class TestdataRaw:
    """Lazy builder of the raw shapes from ``<sf_dir>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str, horizon: Horizon | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        if horizon is not None:
            self.horizon = horizon
        self._tables: dict[str, DataFrame] = {}

    @cached_property
    def horizon(self) -> Horizon:
        """Calendar of the data: first order year to last ship year; open subscriptions
        run to the month of the last order. Customers with orders are counted (roughly) in the
        same pass. One row is brought to the driver."""
        o = self.table("orders").agg(
            F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.approx_count_distinct("o_custkey").alias("n")
        ).first()
        ship = self.table("lineitem").agg(F.max("l_shipdate").alias("hi")).first()["hi"]
        if o["lo"] is None:  # no orders: nothing to date, any calendar will do
            return TESTDATA_HORIZON
        end = max(o["hi"], ship or o["hi"])
        return Horizon(
            dt.date(o["lo"].year, 1, 1), dt.date(end.year, 12, 31), dt.date(o["hi"].year, o["hi"].month, 1), o["n"]
        )

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read
            if name in TEST_TABLE_SCHEMAS:
                reader = reader.schema(TEST_TABLE_SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @property
    def _geo(self) -> DataFrame:
        """Nations with their region."""
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", "r_name")

    # -- accounts and subscriptions share one per-customer order summary ----------------
    @cached_property
    def _account_base(self) -> DataFrame:
        span = self.table("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")
        )
        c = self.table("customer")
        key = F.col("c_custkey")
        return (
            c.join(F.broadcast(self._geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(span, key == F.col("o_custkey"))
            .select(
                key.alias("account_id"),
                F.col("c_name").alias("account_name"),
                segment_of(F.col("c_mktsegment")).alias("segment"),
                F.when(F.col("c_acctbal") < 2500, "1-50")
                .when(F.col("c_acctbal") < 5000, "51-200")
                .when(F.col("c_acctbal") < 8000, "201-1000")
                .otherwise("1000+")
                .alias("company_size"),
                F.col("r_name").alias("region"),
                pick(MARKETING_CHANNELS, F.pmod(key, F.lit(5))).alias("acquisition_channel"),
                F.col("first_order").alias("created_at"),
                F.when(F.pmod(key, F.lit(50)) == 0, "Inactive").otherwise("Active").alias("status"),
                F.col("last_order"),
            )
        )

    def raw_accounts(self) -> DataFrame:
        return self._account_base.drop("last_order")

    def raw_users(self) -> DataFrame:
        uid = F.col("user_id")
        r = F.pmod(uid, F.lit(5))
        return (
            self.table("events")
            .groupBy("user_id")
            .agg(F.min("ts").alias("created_at"))
            .select(
                uid,
                _div(uid, 3).alias("account_id"),
                F.concat(F.lit("u"), uid.cast("string"), F.lit("@example.test")).alias("email"),
                F.when(r == 0, "Admin").when(r == 4, "Viewer").otherwise("User").alias("role"),
                "created_at",
            )
        )

    def raw_subscriptions(self) -> DataFrame:
        a = self._account_base
        start = F.to_date("created_at")
        last = F.to_date("last_order")
        ended = (F.pmod(F.col("account_id"), F.lit(7)) == 0) & (last > F.date_add(start, 90))
        end = F.when(ended, last)
        return a.select(
            F.col("account_id").alias("subscription_id"),
            "account_id",
            pick(PLAN_TIERS, F.pmod(F.col("account_id"), F.lit(4))).alias("plan_tier"),
            start.alias("start_date"),
            end.alias("end_date"),
            F.when(ended, "Cancelled").otherwise("Active").alias("status"),
        )

    def raw_invoices(self) -> DataFrame:
        # dealt out by account before they expand to months: few bytes, but many invoices
        s = deal_out(self._subscriptions, "account_id", self.horizon)
        start = F.col("start_date")
        first = F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(F.trunc(start, "MM"), 1))
        last = F.trunc(F.coalesce(F.col("end_date"), F.lit(self.horizon.open_end)), "MM")
        months = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
        m = s.select("account_id", F.explode(months).alias("invoice_date"))
        acc, mon, yr = F.col("account_id"), F.month("invoice_date"), F.year("invoice_date")
        tier = F.pmod(acc, F.lit(4))
        surge = F.pmod(acc * 31 + mon * 17 + yr * 13, F.lit(20)) == 0
        status_key = F.pmod(acc * 7 + mon * 5 + yr * 3, F.lit(29))
        return m.select(
            (acc * 1000 + (yr - 1995) * 12 + mon).alias("invoice_id"),
            acc.alias("subscription_id"),
            acc,
            "invoice_date",
            F.when(surge, pick(SURGE_PRICES, tier)).otherwise(pick([float(p) for p in PLAN_PRICES], tier)).alias("amount"),
            F.when(status_key == 0, "Failed").when(status_key == 1, "Pending").otherwise("Paid").alias("status"),
        )

    @cached_property
    def _subscriptions(self) -> DataFrame:
        return self.raw_subscriptions()

    @cached_property
    def _invoices(self) -> DataFrame:
        return self.raw_invoices()

    def raw_payments(self) -> DataFrame:
        i = self._invoices.filter(F.col("status") == "Paid")
        iid = F.col("invoice_id")
        return i.select(
            iid.alias("payment_id"),
            iid,
            F.date_add(F.col("invoice_date"), (F.pmod(iid, F.lit(10)) + 1).cast("int")).alias("payment_date"),
            "amount",
            pick(PAYMENT_METHODS, F.pmod(iid, F.lit(3))).alias("payment_method"),
        )

    def raw_crm_deals(self) -> DataFrame:
        cust = self.table("customer").join(F.broadcast(self._geo), F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "c_mktsegment"
        )
        o = self.table("orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
        status = F.col("o_orderstatus")
        prio = F.substring("o_orderpriority", 1, 1).cast("int")
        stage = (
            F.when(status == "F", "Closed Won")
            .when(status == "O", "Closed Lost")
            .when(status == "P", pick(OPEN_STAGES_BY_PRIORITY, prio - 1))
        )
        cycle = F.pmod(F.col("o_orderkey"), F.lit(71)) + 20
        created = F.to_date("o_orderdate")
        return o.select(
            F.col("o_orderkey").alias("deal_id"),
            F.when(status != "O", F.col("o_custkey")).alias("account_id"),
            F.floor("o_totalprice").cast("long").alias("deal_value"),
            stage.alias("stage"),
            created.alias("created_date"),
            F.when(status.isin("F", "O"), F.date_add(created, cycle.cast("int"))).alias("closed_date"),
            cycle.cast("long").alias("sales_cycle_days"),
            segment_of(F.col("c_mktsegment")).alias("segment"),
        )

    def raw_product_events(self) -> DataFrame:
        e = self.table("events").filter(F.col("event_type") != "error")
        t = F.col("event_type")
        mapped = (
            F.when(t == "view", "login")
            .when(t == "click", "feature_use")
            .when(t == "purchase", "weekly_active")
            .when(t == "signup", F.when(F.col("value") >= 120, "activation").otherwise("feature_use"))
        )
        return e.select(
            "event_id",
            "user_id",
            _div(F.col("user_id"), 3).alias("account_id"),
            mapped.alias("event_type"),
            F.col("ts").alias("event_timestamp"),
        )

    def raw_support_tickets(self) -> DataFrame:
        e = self.table("events").filter(F.col("event_type") == "error")
        eid = F.col("event_id")
        r = F.pmod(eid, F.lit(20))
        severity = F.when(r < 10, "Low").when(r < 16, "Medium").when(r < 19, "High").otherwise("Critical")
        sla = F.when(r < 10, 48).when(r < 16, 24).when(r < 19, 8).otherwise(2).cast("long")
        h = F.pmod(eid * 7919, F.lit(1000))
        scaled = sla * (h + 500)  # resolution in 1/1000 of the SLA hours
        return e.select(
            eid.alias("ticket_id"),
            _div(F.col("user_id"), 3).alias("account_id"),
            pick(SUPPORT_CATEGORIES, F.pmod(eid, F.lit(4))).alias("category"),
            severity.alias("severity"),
            F.col("ts").alias("created_at"),
            F.timestamp_add("MILLISECOND", scaled * 3600, F.col("ts")).alias("resolved_at"),
            sla.alias("sla_hours"),
            (_div(scaled + 50, 100) / F.lit(10.0)).alias("resolution_hours"),
            (h > 500).alias("sla_breached"),
        )

    def raw_marketing_spend(self) -> DataFrame:
        li = self.table("lineitem")
        agg = li.groupBy(
            F.trunc(F.to_date("l_shipdate"), "MM").alias("month"),
            F.pmod(F.col("l_suppkey"), F.lit(6)).alias("bucket"),
        ).agg(
            F.sum(F.floor("l_extendedprice")).alias("spend_units"),
            F.count(F.lit(1)).alias("leads_generated"),
        )
        channel = pick(TEST_CHANNELS, F.col("bucket"))
        return agg.select(
            "month",
            channel.alias("channel"),
            (F.col("spend_units").cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("double").alias("spend"),
            "leads_generated",
            F.concat_ws(" ", channel, F.date_format("month", "MMM yyyy")).alias("campaign_name"),
        )

    def all(self) -> "LazyTables":
        """All nine raw shapes; each plan is built on first access only."""
        builders = {name: getattr(self, name) for name in RAW_TABLES}
        # Subscriptions and invoices feed other shapes: share one plan object each.
        builders["raw_subscriptions"] = lambda: self._subscriptions
        builders["raw_invoices"] = lambda: self._invoices
        return LazyTables(builders)


class LazyTables(Mapping):
    """Read-only mapping whose values are built on first access and then kept."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)
