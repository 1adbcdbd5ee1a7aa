"""Staging relations: fixed projections with explicit casts, one per raw table.

Input contract: amounts have at most two decimals (``to_money`` fails on finer ones).
A staging relation is a pure ``DataFrame -> DataFrame`` function (a view: Catalyst
inlines it, and a cast that is already satisfied by the input type disappears).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.sources.files import CORRUPT

TS, DATE, MONEY = "timestamp_ntz", "date", "decimal(18,2)"

# staged name -> (raw name, [(column, cast or None)])
STAGING: dict[str, tuple[str, list[tuple[str, str | None]]]] = {
    "stg_accounts": ("raw_accounts", [
        ("account_id", None), ("account_name", None), ("segment", None), ("company_size", None),
        ("region", None), ("acquisition_channel", None), ("created_at", TS), ("status", None),
    ]),
    "stg_users": ("raw_users", [
        ("user_id", None), ("account_id", None), ("email", None), ("role", None), ("created_at", TS),
    ]),
    "stg_subscriptions": ("raw_subscriptions", [
        ("subscription_id", None), ("account_id", None), ("plan_tier", None), ("start_date", DATE),
        ("end_date", DATE), ("status", None),
    ]),
    "stg_invoices": ("raw_invoices", [
        ("invoice_id", None), ("subscription_id", None), ("account_id", None), ("invoice_date", DATE),
        ("amount", MONEY), ("status", None),
    ]),
    "stg_payments": ("raw_payments", [
        ("payment_id", None), ("invoice_id", None), ("payment_date", DATE), ("amount", MONEY),
        ("payment_method", None),
    ]),
    "stg_crm_deals": ("raw_crm_deals", [
        ("deal_id", None), ("account_id", None), ("deal_value", None), ("stage", None),
        ("created_date", DATE), ("closed_date", DATE), ("sales_cycle_days", None), ("segment", None),
    ]),
    "stg_product_events": ("raw_product_events", [
        ("event_id", None), ("user_id", None), ("account_id", None), ("event_type", None),
        ("event_timestamp", TS),
    ]),
    "stg_support_tickets": ("raw_support_tickets", [
        ("ticket_id", None), ("account_id", None), ("category", None), ("severity", None),
        ("created_at", TS), ("resolved_at", TS), ("sla_hours", None), ("resolution_hours", None),
        ("sla_breached", None),
    ]),
    "stg_marketing_spend": ("raw_marketing_spend", [
        ("month", DATE), ("channel", None), ("spend", MONEY), ("leads_generated", None),
        ("campaign_name", None),
    ]),
}


def to_money(c: Column) -> Column:
    """Two-decimal money; a finer amount breaks the input contract and fails the query."""
    money = c.cast(MONEY)
    fits = c.isNull() | (money.cast("double") == c.cast("double"))
    return F.when(fits, money).otherwise(F.raise_error(F.concat(F.lit("amount finer than a cent: "), c.cast("string"))))


def stage(name: str, raw: DataFrame) -> DataFrame:
    """Apply the staging projection ``name`` to its raw table."""
    _, cols = STAGING[name]

    def staged(c: str, kind: str | None) -> Column:
        if kind == MONEY:
            return to_money(F.col(c))
        return F.col(c).cast(kind) if kind else F.col(c)

    return raw.select(*[staged(c, t).alias(c) for c, t in cols])


def staging_sql(name: str, raw: T.StructType, source: str) -> str:
    """The projection ``name`` as SQL text over the table ``source``, whose columns are ``raw``."""
    _, cols = STAGING[name]

    def staged(c: str, kind: str | None) -> str:
        if not kind or raw[c].dataType.simpleString() == kind:
            return c
        cast = f"CAST({c} AS {kind})"
        if kind != MONEY:
            return f"{cast} AS {c}"
        fits = f"{c} IS NULL OR CAST({cast} AS DOUBLE) = CAST({c} AS DOUBLE)"
        return f"CASE WHEN {fits} THEN {cast} ELSE raise_error(concat('amount finer than a cent: ', CAST({c} AS STRING))) END AS {c}"

    return f"SELECT {', '.join(staged(c, t) for c, t in cols)} FROM {source}"


PROBLEM = "problems"


def check_rows(name: str, raw: DataFrame) -> DataFrame:
    """The staged relation ``name`` with ``problems``: why a raw row cannot be staged (empty for
    a row that can), e.g. ``start_date: not a date: 2024-13-01``.

    A value that does not cast becomes null and a problem instead of an error, as do an
    amount finer than a cent and (from ``read_dirty_csv``) a line with too few or unreadable fields.
    """
    _, cols = STAGING[name]
    problems, staged = [], []
    for c, kind in cols:
        value = F.col(c)
        if kind:
            value = value.try_cast(kind)
            wrong = F.col(c).isNotNull() & value.isNull()
            problems.append(F.when(wrong, F.concat(F.lit(f"{c}: not a {kind}: "), F.col(c).cast("string"))))
            if kind == MONEY:
                finer = value.cast("double") != F.col(c).try_cast("double")
                problems.append(F.when(finer, F.concat(F.lit(f"{c}: finer than a cent: "), F.col(c).cast("string"))))
                value = F.when(~F.coalesce(finer, F.lit(False)), value)
        staged.append(value.alias(c))
    if CORRUPT in raw.columns:
        problems.append(F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("unreadable line: "), F.col(CORRUPT))))
    every = F.filter(F.array(*problems), lambda p: p.isNotNull()) if problems else F.array().cast("array<string>")
    return raw.select(*staged, every.alias(PROBLEM))


def stage_clean(name: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staged rows, quarantine) of a raw table that may be dirty; every row is in one of the two.

    Quarantined rows are ``(model, record, problems)``, the staged values of the record as JSON.
    """
    checked = check_rows(name, raw)
    good = checked.where(F.size(PROBLEM) == 0).drop(PROBLEM)
    bad = checked.where(F.size(PROBLEM) > 0)
    record = F.to_json(F.struct(*[c for c in checked.columns if c != PROBLEM]))
    return good, bad.select(F.lit(name).alias("model"), record.alias("record"), PROBLEM)
