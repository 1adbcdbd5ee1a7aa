"""Explicit schemas of the nine raw tables.

Raw = what a headered CSV export of the product database holds: ids and categories as
text, dates and timestamps as text (cast in staging), money and hours as double,
counts as bigint, the SLA flag as boolean. Reads never infer types.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "raw_accounts": _st(
        ("account_id", S), ("account_name", S), ("segment", S), ("company_size", S),
        ("region", S), ("acquisition_channel", S), ("created_at", S), ("status", S),
    ),
    "raw_users": _st(("user_id", S), ("account_id", S), ("email", S), ("role", S), ("created_at", S)),
    "raw_subscriptions": _st(
        ("subscription_id", S), ("account_id", S), ("plan_tier", S), ("start_date", S),
        ("end_date", S), ("status", S),
    ),
    "raw_invoices": _st(
        ("invoice_id", S), ("subscription_id", S), ("account_id", S), ("invoice_date", S),
        ("amount", D), ("status", S),
    ),
    "raw_payments": _st(
        ("payment_id", S), ("invoice_id", S), ("payment_date", S), ("amount", D), ("payment_method", S),
    ),
    "raw_crm_deals": _st(
        ("deal_id", S), ("account_id", S), ("deal_value", L), ("stage", S), ("created_date", S),
        ("closed_date", S), ("sales_cycle_days", L), ("segment", S),
    ),
    "raw_product_events": _st(
        ("event_id", S), ("user_id", S), ("account_id", S), ("event_type", S), ("event_timestamp", S),
    ),
    "raw_support_tickets": _st(
        ("ticket_id", S), ("account_id", S), ("category", S), ("severity", S), ("created_at", S),
        ("resolved_at", S), ("sla_hours", L), ("resolution_hours", D), ("sla_breached", B),
    ),
    "raw_marketing_spend": _st(
        ("month", S), ("channel", S), ("spend", D), ("leads_generated", L), ("campaign_name", S),
    ),
}

# Export file name of each raw table (the loader's dataset registry).
RAW_FILES: dict[str, str] = {
    "raw_accounts": "accounts.csv",
    "raw_users": "users.csv",
    "raw_subscriptions": "subscriptions.csv",
    "raw_invoices": "invoices.csv",
    "raw_payments": "payments.csv",
    "raw_crm_deals": "crm_deals.csv",
    "raw_product_events": "product_events.csv",
    "raw_support_tickets": "support_tickets.csv",
    "raw_marketing_spend": "marketing_spend.csv",
}

RAW_TABLES = list(RAW_FILES)
