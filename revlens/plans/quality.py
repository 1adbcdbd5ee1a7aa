"""The data-quality suite: 39 declarative column rules and 2 singular assertions.

All rules are evaluated together (``_counted``): one pass over each model and one aggregation
by typed key. ``run_checks`` sums the failures of each rule, ``violations`` lists the
violating values of one kind.
Failures follow the usual test-runner counting: rows returned by the failing query
(duplicated values, null rows, distinct unaccepted values, orphan child rows).
Every rule has severity ``warn``: failures are reported, the run is not stopped.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.plans.model import Warehouse
from revlens.sources.values import (
    ACCOUNT_STATUSES,
    ANOMALY_TYPES,
    DEAL_STAGES,
    EVENT_TYPES,
    INVOICE_STATUSES,
    SEGMENTS,
    SEVERITIES,
    SUBSCRIPTION_STATUSES,
)

# (model, column, rule, argument) — argument: accepted values, or (parent model, parent column).
RULES: list[tuple[str, str, str, object]] = [
    ("stg_accounts", "account_id", "unique", None),
    ("stg_accounts", "account_id", "not_null", None),
    ("stg_accounts", "segment", "accepted_values", SEGMENTS),
    ("stg_accounts", "status", "accepted_values", ACCOUNT_STATUSES),
    ("stg_subscriptions", "subscription_id", "unique", None),
    ("stg_subscriptions", "subscription_id", "not_null", None),
    ("stg_subscriptions", "account_id", "not_null", None),
    ("stg_subscriptions", "account_id", "relationships", ("stg_accounts", "account_id")),
    ("stg_subscriptions", "status", "accepted_values", SUBSCRIPTION_STATUSES),
    ("stg_invoices", "invoice_id", "unique", None),
    ("stg_invoices", "invoice_id", "not_null", None),
    ("stg_invoices", "account_id", "relationships", ("stg_accounts", "account_id")),
    ("stg_invoices", "status", "accepted_values", INVOICE_STATUSES),
    ("stg_crm_deals", "deal_id", "unique", None),
    ("stg_crm_deals", "deal_id", "not_null", None),
    ("stg_crm_deals", "stage", "accepted_values", DEAL_STAGES),
    ("stg_product_events", "event_id", "unique", None),
    ("stg_product_events", "event_id", "not_null", None),
    ("stg_product_events", "event_type", "accepted_values", EVENT_TYPES),
    ("stg_support_tickets", "ticket_id", "unique", None),
    ("stg_support_tickets", "ticket_id", "not_null", None),
    ("stg_support_tickets", "severity", "accepted_values", SEVERITIES),
    ("dim_date", "date", "unique", None),
    ("dim_date", "date", "not_null", None),
    ("dim_account", "account_id", "unique", None),
    ("dim_account", "account_id", "not_null", None),
    ("fct_revenue_monthly", "account_id", "relationships", ("dim_account", "account_id")),
    ("fct_revenue_monthly", "revenue_month", "relationships", ("dim_date", "date")),
    ("fct_pipeline", "segment", "accepted_values", SEGMENTS),
    ("fct_activation", "account_id", "unique", None),
    ("fct_activation", "account_id", "not_null", None),
    ("fct_activation", "account_id", "relationships", ("dim_account", "account_id")),
    ("fct_retention", "cohort_month", "not_null", None),
    ("fct_support", "account_id", "unique", None),
    ("fct_support", "account_id", "not_null", None),
    ("fct_support", "account_id", "relationships", ("dim_account", "account_id")),
    ("fct_cac_ltv", "channel", "unique", None),
    ("fct_cac_ltv", "channel", "not_null", None),
    ("fct_anomalies", "anomaly_type", "accepted_values", ANOMALY_TYPES),
]

SUMMARY_COLUMNS = ["model", "column", "rule", "failures", "status"]


class _Keys:
    """The key columns of unique and relationship rules, in groups that are compared.

    Columns that a relationship links, directly or by others, are members of one group, so
    that one entry of a row serves all rules of its key. A group of whole numbers or dates
    is keyed by a long, any other one by text.
    """

    def __init__(self, wh: Warehouse, rules: list[tuple]):
        columns: dict[tuple[str, str], int] = {}

        def join(*keys: tuple[str, str]) -> None:
            groups = [columns.setdefault(k, len(columns)) for k in keys]
            for k, g in columns.items():
                if g in groups:
                    columns[k] = min(groups)

        for model, column, rule, arg in rules:
            if rule == "unique":
                join((model, column))
            elif rule == "relationships":
                join((model, column), tuple(arg))
        self.group = columns
        self.member: dict[tuple[str, str], int] = {}
        kinds: dict[int, set[str]] = defaultdict(set)
        for k, g in columns.items():
            self.member[k] = sum(1 for other in self.member if columns[other] == g)
            t = wh.ref(k[0]).schema[k[1]].dataType
            kinds[g].add("date" if isinstance(t, T.DateType) else "long" if isinstance(t, T.IntegralType) else "text")
        self.kind = {g: next(iter(k)) if len(k) == 1 else "text" for g, k in kinds.items()}
        self.members = max(self.member.values(), default=-1) + 1

    def entry(self, key: tuple[str, str]) -> str:
        c, group = _quoted(key[1]), self.group[key]
        kind = self.kind[group]
        if kind == "text":
            own = _entry(group, text=f"CAST({c} AS STRING)", member=self.member[key])
        else:
            number = f"unix_date({c})" if kind == "date" else c
            own = _entry(group, number=f"CAST({number} AS BIGINT)", member=self.member[key])
        return f"IF({c} IS NOT NULL, {own}, NULL)"

    def value(self, group: int) -> str:
        kind = self.kind[group]
        if kind == "text":
            return "text"
        return f"CAST({'date_from_unix_date(CAST(number AS INT))' if kind == 'date' else 'number'} AS STRING)"


# The suite has hundreds of small expressions. They hold only column names and numbers, and are
# written as SQL text: each one is a single call into the JVM then, instead of one per function.


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _entry(group: int, number: str = "CAST(NULL AS BIGINT)", text: str = "CAST(NULL AS STRING)", member: int = 0) -> str:
    return f"named_struct('group', {group}, 'number', {number}, 'text', {text}, 'member', {member})"


def _named(rules: list[tuple]) -> Column:
    """Model, column and rule of the rule at position ``k``, from one literal."""
    names = json.dumps([{"model": m, "column": c, "rule": r} for m, c, r, _ in rules])
    return F.from_json(F.lit(names), "array<struct<model string, column string, rule string>>")[F.col("k")]


def _counted(wh: Warehouse, rules: list[tuple]) -> tuple[DataFrame, dict[int, tuple[str, str, str]]]:
    """Rows per key of every model, and per rule (by position) what to read off a row, as SQL:
    whether it violates the rule, the value, and how many rows of the model do so.

    Every model is read once: a row yields an entry for each of its key columns, and one for
    each null or unaccepted value. One aggregation by (group, key) counts them per member;
    its partial sums fold hot keys before the shuffle.
    """
    keys = _Keys(wh, rules)
    entries: dict[str, list[Column]] = defaultdict(list)
    for key in keys.group:
        entries[key[0]].append(F.expr(keys.entry(key)))
    for k, (model, column, rule, arg) in enumerate(rules):
        c = _quoted(column)
        if rule == "not_null":
            entries[model].append(F.expr(f"IF({c} IS NULL, {_entry(-1 - k)}, NULL)"))
        elif rule == "accepted_values":  # the values are bound, not written into the text
            entries[model].append(F.when(~F.col(c).isin(*arg), F.expr(_entry(-1 - k, text=f"CAST({c} AS STRING)"))))
        elif rule not in ("unique", "relationships"):
            raise ValueError(f"unknown rule {rule!r}")
    found = reduce(DataFrame.union, [wh.ref(model).select(F.inline(F.array(*cols))) for model, cols in entries.items()])
    counts = [F.expr(f"count_if(member = {m}) AS n{m}") for m in range(max(keys.members, 1))]
    per_key = found.filter("`group` IS NOT NULL").groupBy("group", "number", "text").agg(*counts)

    broken = {}
    for k, (model, column, rule, arg) in enumerate(rules):
        if rule in ("not_null", "accepted_values"):
            broken[k] = (f"`group` = {-1 - k}", "text", "n0")
            continue
        group, n = keys.group[model, column], f"n{keys.member[model, column]}"
        wrong = f"{n} > 1" if rule == "unique" else f"{n} > 0 AND n{keys.member[tuple(arg)]} = 0"
        broken[k] = (f"`group` = {group} AND {wrong}", keys.value(group), n)
    return per_key, broken


def run_checks(wh: Warehouse, rules=RULES, severity: str = "warn") -> DataFrame:
    """Summary ``(model, column, rule, failures, status)`` with one row per rule."""
    rules = list(rules)
    per_key, broken = _counted(wh, rules)
    by_rows = ("not_null", "relationships")  # these fail once per row, the others once per value
    totals = per_key.agg(*[
        F.expr(f"coalesce(sum(IF({wrong}, {n if rules[k][2] in by_rows else '1L'}, NULL)), 0L) AS r{k}") for k, (wrong, _, n) in broken.items()
    ])
    summary = totals.selectExpr(f"posexplode(array({', '.join(f'r{k}' for k in broken)})) AS (k, failures)")
    summary = summary.withColumn("of", _named(rules)).select("of.*", "failures")
    return summary.withColumn("status", F.when(F.col("failures") > 0, severity).otherwise("pass"))


class QualityError(RuntimeError):
    """Raised by ``enforce`` when a rule of blocking severity has failures (``blocking``)."""

    def __init__(self, message: str, blocking: list[dict]):
        super().__init__(message)
        self.blocking = blocking


def enforce(summary: DataFrame, fail_on: str = "error") -> list[dict]:
    """Collect the (one row per rule) summary; raise if a rule with status ``fail_on`` failed.

    With the default ``warn`` severity nothing blocks: failures are returned for reporting.
    """
    rows = [r.asDict() for r in summary.collect()]  # bounded: one row per rule
    blocking = [r for r in rows if r["status"] == fail_on and r["failures"] > 0]
    if blocking:
        names = ", ".join(f"{r['model']}.{r['column']}:{r['rule']}={r['failures']}" for r in blocking)
        raise QualityError(f"{len(blocking)} blocking quality rule(s) failed: {names}", blocking)
    return rows


def violations(wh: Warehouse, kind: str, rules=RULES) -> DataFrame:
    """Violating values of all rules of one kind, ``(model, column, value, rows)``."""
    chosen = [r for r in rules if r[2] == kind]
    per_key, broken = _counted(wh, chosen)
    found = ", ".join(
        f"IF({wrong}, named_struct('k', {k}, 'value', {value}, 'rows', {n}), NULL)" for k, (wrong, value, n) in broken.items()
    )
    rows = per_key.selectExpr(f"inline(array({found}))").filter("k IS NOT NULL")
    return rows.withColumn("of", _named(chosen)).select("of.model", "of.column", "value", "rows")


# Rules that the test tables break: each kind finds something when it is run over them.
BROKEN_RULES: list[tuple[str, str, str, object]] = [
    ("stg_crm_deals", "account_id", "unique", None),
    ("stg_crm_deals", "account_id", "not_null", None),
    ("stg_product_events", "event_type", "accepted_values", [t for t in EVENT_TYPES if t != "activation"]),
    ("stg_accounts", "account_id", "relationships", ("stg_support_tickets", "account_id")),
    ("stg_subscriptions", "end_date", "not_null", None),
    ("stg_accounts", "account_id", "unique", None),
]


def negative_balances(customers: DataFrame) -> DataFrame:
    """Customers whose balance is below zero (the sign rule on the customer table)."""
    return customers.where(F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal")


def shipped_before_order(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items that left before their order's date, counted per order (the date rule)."""
    li = lineitem.select("l_orderkey", "l_shipdate")
    o = orders.select("o_orderkey", "o_orderdate")
    early = li.join(o, li["l_orderkey"] == o["o_orderkey"]).where(F.col("l_shipdate") < F.col("o_orderdate"))
    return early.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("items"), F.min("l_shipdate").alias("first_shipped"))


def non_negative_amounts(wh: Warehouse) -> DataFrame:
    """Negative invoice amounts and negative monthly revenue (two-branch union).

    The staged amount is a checked cast. A filter on it is pushed below the projection that
    stages it and repeats the cast for each place it stands in; a generator reads it as it is.
    """
    staged = wh.ref("stg_invoices").select("invoice_id", "account_id", "invoice_date", "amount")
    found = F.when(F.col("amount") < 0, F.array(F.struct(*[F.col(c) for c in staged.columns])))
    inv = staged.select(F.inline(found)).withColumn("amount", F.col("amount").cast("decimal(38,2)"))
    rev = wh.ref("fct_revenue_monthly").where(F.col("mrr") < 0).select(
        F.lit(None).cast(inv.schema["invoice_id"].dataType).alias("invoice_id"),
        "account_id",
        F.col("revenue_month").alias("invoice_date"),
        F.col("mrr").cast("decimal(38,2)").alias("amount"),
    )
    return inv.unionByName(rev)


def valid_subscription_dates(wh: Warehouse) -> DataFrame:
    """Reversed subscription ranges, and invoices dated outside their subscription.

    The two branches have different shapes (4 and 5 columns); they are combined as a
    tagged union by name, the missing column being null.
    """
    s = wh.ref("stg_subscriptions")
    reversed_ranges = s.where(F.col("end_date").isNotNull() & (F.col("start_date") > F.col("end_date"))).select(
        F.lit("subscription_dates").alias("check"), "subscription_id", "account_id", "start_date", "end_date"
    )
    i = wh.ref("stg_invoices").select("subscription_id", "account_id", "invoice_date")
    subs = s.select(F.col("subscription_id").alias("_sid"), "start_date", "end_date")
    outside = (F.col("invoice_date") < F.col("start_date")) | (
        F.col("end_date").isNotNull() & (F.col("invoice_date") > F.col("end_date"))
    )
    bad_invoices = i.join(subs, i["subscription_id"] == subs["_sid"]).where(outside).select(
        F.lit("invoice_dates").alias("check"),
        F.lit(None).cast(s.schema["subscription_id"].dataType).alias("subscription_id"),
        "account_id", "invoice_date", "start_date", "end_date",
    )
    return reversed_ranges.unionByName(bad_invoices, allowMissingColumns=True)
