"""The command line: build marts into a folder, run the quality suite, show a dashboard."""

from __future__ import annotations

import os

from revlens.__main__ import main
from revlens.session import scratch_dir

SF = "/root/testdata/sf0.001"


def test_build_test_show(spark, capsys):
    out = scratch_dir(spark, "test-cli")
    assert main(["build", "--testdata", SF, "--out", out]) == 0
    assert os.path.isdir(f"{out}/fct_revenue_monthly") or out.startswith("file:")
    assert main(["test", "--testdata", SF]) == 0  # warn severity: reported, exit 0
    assert main(["show", "dash_tickets_by_segment", "--testdata", SF, "--region", "ASIA"]) == 0
    printed = capsys.readouterr().out
    assert "built fct_anomalies" in printed and "tickets" in printed and "unique" in printed


def test_show_filters_and_rows_left_out(spark, capsys):
    import pytest

    from revlens.session import scratch_dir

    assert main(["show", "dash_mrr_trend", "--testdata", SF, "--limit", "2"]) == 0
    assert "more rows" in capsys.readouterr().out
    assert main(["show", "dash_churn_by_cohort", "--testdata", SF]) == 0
    with pytest.raises(SystemExit):  # this query has no filters
        main(["show", "dash_churn_by_cohort", "--testdata", SF, "--region", "ASIA"])
    out = scratch_dir(spark, "test-show")
    assert main(["show", "dash_mrr_trend", "--testdata", SF, "--out", out]) == 0
    assert spark.read.parquet(out).count() > 2
