"""Quality rules on damaged frames; typed CSV reads; the load report."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

from helpers import account, invoice, subscription, warehouse
from revlens.config import TESTDATA_HORIZON
from revlens.plans import quality as Q
from revlens.plans.model import Warehouse
from revlens.sources.files import load_report, read_raw


def damaged(spark):
    return warehouse(
        spark,
        raw_accounts=[account("A1"), account("A1"), account("A2", segment=None), account("A3", segment="Startup")],
        raw_subscriptions=[
            subscription("S1", "A1", "2025-03-01", "2025-01-31", "Cancelled"),  # reversed dates
            subscription("S2", None, "2025-01-01"),  # null foreign key
            subscription("S3", "ZZ", "2025-01-01"),  # orphan key
        ],
        raw_invoices=[
            invoice("I1", "S1", "A1", "2025-02-01", -5),  # negative, outside its subscription
            invoice("I1", "S2", "A2", "2025-01-01", 10),  # duplicate id
            invoice("I3", "S3", "ZZ", "2024-12-01", 10, status="Refunded"),  # orphan, bad status, early
        ],
    )


def test_generic_rules_count_failures(spark):
    wh = damaged(spark)
    rules = [r for r in Q.RULES if r[0].startswith("stg_") and r[0] in ("stg_accounts", "stg_subscriptions", "stg_invoices")]
    got = {(x["model"], x["column"], x["rule"]): (x["failures"], x["status"]) for x in Q.run_checks(wh, rules).collect()}
    assert got[("stg_accounts", "account_id", "unique")] == (1, "warn")
    assert got[("stg_accounts", "account_id", "not_null")] == (0, "pass")
    assert got[("stg_accounts", "segment", "accepted_values")] == (1, "warn")  # null passes
    assert got[("stg_subscriptions", "account_id", "not_null")] == (1, "warn")
    assert got[("stg_subscriptions", "account_id", "relationships")] == (1, "warn")  # null child passes
    assert got[("stg_invoices", "invoice_id", "unique")] == (1, "warn")
    assert got[("stg_invoices", "account_id", "relationships")] == (1, "warn")
    assert got[("stg_invoices", "status", "accepted_values")] == (1, "warn")
    assert len(got) == len(rules)


def test_violation_rows(spark):
    wh = damaged(spark)
    v = {(x["model"], x["column"], x["value"]): x["rows"] for x in Q.violations(wh, "unique").collect()}
    assert v[("stg_accounts", "account_id", "A1")] == 2
    neg = Q.non_negative_amounts(wh).collect()
    assert [(r["invoice_id"], r["amount"]) for r in neg] == [("I1", Decimal("-5.00"))]
    dates = Q.valid_subscription_dates(wh).collect()
    kinds = sorted((r["check"], r["account_id"]) for r in dates)
    assert ("subscription_dates", "A1") in kinds
    assert ("invoice_dates", "ZZ") in kinds  # invoice before its subscription start
    assert all(r["subscription_id"] is None for r in dates if r["check"] == "invoice_dates")


def test_typed_csv_read_and_missing_file(spark):
    folder = tempfile.mkdtemp(prefix="revlens-csv-")
    with open(os.path.join(folder, "support_tickets.csv"), "w") as f:
        f.write("ticket_id,account_id,category,severity,created_at,resolved_at,sla_hours,resolution_hours,sla_breached\n")
        f.write("T1,A1,Billing,Low,2025-01-01 10:00:00.123456,,48,1.5,True\n")
        f.write("T2,A1,Billing,High,2025-01-02 00:00:00,2025-01-02 09:00:00,8,9.0,False\n")
    raw = read_raw(spark, folder)
    assert list(raw) == ["raw_support_tickets"]  # the other files are skipped
    from revlens.plans.staging import stage

    st = {r["ticket_id"]: r for r in stage("stg_support_tickets", raw["raw_support_tickets"]).collect()}
    assert st["T1"]["created_at"] == dt.datetime(2025, 1, 1, 10, 0, 0, 123456)
    assert st["T1"]["resolved_at"] is None
    assert st["T1"]["sla_breached"] is True and st["T2"]["sla_breached"] is False
    assert st["T2"]["resolution_hours"] == 9.0
    rep = {r["table"]: r["rows"] for r in load_report(raw).collect()}
    assert rep == {"raw_support_tickets": 2, "total": 2}


def test_amounts_finer_than_a_cent_fail(spark):
    import pytest

    wh = warehouse(spark, raw_invoices=[invoice("I1", "S1", "A1", "2025-01-01", 10.005)])
    with pytest.raises(Exception, match="finer than a cent"):
        wh.ref("stg_invoices").collect()


def test_scratch_folders_can_be_removed(spark):
    from revlens import session

    path = session.scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    keep, session._made[:] = session._made[:-1], session._made[-1:]
    assert session.remove_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file://"))
    session._made[:] = keep


def test_severity_warn_reports_and_error_blocks(spark):
    import pytest

    wh = damaged(spark)
    rules = [r for r in Q.RULES if r[0] == "stg_accounts"]
    rows = Q.enforce(Q.run_checks(wh, rules))  # warn: reported, not raised
    assert any(r["status"] == "warn" for r in rows)
    with pytest.raises(Q.QualityError):
        Q.enforce(Q.run_checks(wh, rules, severity="error"))


def test_amount_check_is_staged_once(spark):
    wh = warehouse(
        spark,
        raw_accounts=[account("a")], raw_subscriptions=[subscription("s", "a", "2025-01-01")],
        raw_invoices=[invoice("i1", "s", "a", "2025-01-01", -5.25), invoice("i2", "s", "a", "2025-02-01", 7), ("i3", "s", "a", "2025-03-01", None, "Paid")],
    )
    found = Q.non_negative_amounts(wh)
    assert [tuple(r)[:2] + (float(r["amount"]),) for r in found.collect()] == [("i1", "a", -5.25)]
    tables = Warehouse.from_testdata(spark, "/root/testdata/sf0.001", TESTDATA_HORIZON)
    plan = Q.non_negative_amounts(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("finer than a cent") == 2  # once a branch: the filter does not repeat the cast
