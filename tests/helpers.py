"""Hand-made raw frames for unit tests (raw CSV contract: dates as text)."""

from __future__ import annotations

from revlens.config import PRODUCT_HORIZON
from revlens.plans.model import Warehouse
from revlens.sources.schemas import RAW_SCHEMAS


def raw_frames(spark, **tables):
    """Build every raw table (empty unless given) from lists of tuples."""
    out = {}
    for name, schema in RAW_SCHEMAS.items():
        rows = tables.get(name, [])
        out[name] = spark.createDataFrame(rows, schema)
    return out


def warehouse(spark, horizon=PRODUCT_HORIZON, **tables):
    return Warehouse(spark, raw_frames(spark, **tables), horizon)


def account(aid, segment="SMB", region="EMEA", channel="Referral", created="2025-01-01 00:00:00", status="Active"):
    return (aid, f"name {aid}", segment, "1-50", region, channel, created, status)


def subscription(sid, aid, start, end=None, status="Active", tier="Starter"):
    return (sid, aid, tier, start, end, status)


def invoice(iid, sid, aid, date, amount, status="Paid"):
    return (iid, sid, aid, date, float(amount), status)
