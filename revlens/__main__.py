"""Command line: load raw tables, build the marts, run the quality suite, show a query.

    python -m revlens build --testdata /root/testdata/sf0.1 --out /shared/warehouse
    python -m revlens build --raw-dir /shared/raw_csv --out /shared/warehouse
    python -m revlens test  --testdata /root/testdata/sf0.1 [--fail-on error]
    python -m revlens show  --testdata /root/testdata/sf0.1 dash_mrr_trend --segment SMB

``build`` writes every mart (a new version, older ones go) in dependency order and prints the load report;
``test`` prints the quality summary (one row per rule); ``show`` prints a dashboard query.
Without ``--master`` the session comes from the environment (spark-submit).
"""

from __future__ import annotations

import argparse
import datetime as dt
import inspect
import sys

from revlens.config import PRODUCT_HORIZON, Filters, Horizon


def _warehouse(spark, args):
    from revlens.plans.model import Warehouse

    if args.testdata:
        return Warehouse.from_testdata(spark, args.testdata)
    horizon = PRODUCT_HORIZON
    if args.horizon:
        start, end, open_end = (dt.date.fromisoformat(x) for x in args.horizon.split(","))
        horizon = Horizon(start, end, open_end)
    return Warehouse.from_files(spark, args.raw_dir, horizon, fmt=args.format)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="revlens")
    p.add_argument("command", choices=["build", "test", "show"])
    p.add_argument("name", nargs="?", help="dashboard query for 'show'")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--testdata", help="folder with the TPC-H-like test tables")
    src.add_argument("--raw-dir", help="folder with the nine raw exports")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--horizon", help="start,end,open_end dates (raw-dir only)")
    p.add_argument("--out", help="warehouse folder for 'build'; folder for the whole result of 'show'")
    p.add_argument("--limit", type=int, default=100, help="rows that 'show' prints; it says how many it left out")
    p.add_argument("--database", help="for 'build': also register the tables, and the staging views, in this database")
    p.add_argument("--buckets", type=int, default=0, help="for 'build' with --database: buckets by account of the marts joined on it")
    p.add_argument("--keep", type=int, default=1, help="versions of a table that 'build' leaves, the new one included")
    p.add_argument("--fail-on", default="error")
    p.add_argument("--segment")
    p.add_argument("--region")
    p.add_argument("--channel")
    p.add_argument("--master", help="local master for a quick run, e.g. local[8]")
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from revlens.session import build_session

    spark = build_session(cores=args.master[6:-1]) if args.master else SparkSession.builder.getOrCreate()
    wh = _warehouse(spark, args)

    if args.command == "build":
        from revlens.plans.model import MART_ORDER
        from revlens.sources.files import observed_report
        from revlens.sources.tables import TableCatalog

        if not args.out:
            p.error("build needs --out")
        folder, counts = f"{args.out.rstrip('/')}/raw", {}
        wh.load_raw(folder, database=args.database, counts=counts, keep=args.keep)
        observed_report(spark, counts).show(20, truncate=False)
        if args.database:
            wh.publish_views(TableCatalog(spark, args.database, folder))
        for name, path in wh.materialize(args.out, MART_ORDER, args.database, args.buckets, args.keep).items():
            print(f"built {name} -> {path}")
    elif args.command == "test":
        from revlens.plans.quality import RULES, QualityError, enforce, run_checks

        summary = run_checks(wh)
        summary.orderBy("model", "column", "rule").show(len(RULES), truncate=False)
        try:
            enforce(summary, fail_on=args.fail_on)
        except QualityError as e:
            print(e, file=sys.stderr)
            return 1
    else:
        from revlens.plans import dashboard as B

        fn = getattr(B, args.name or "", None)
        if fn is None or not args.name.startswith("dash_"):
            p.error("show needs a dashboard query name, e.g. dash_mrr_trend")
        flt = Filters(args.segment, args.region, args.channel)
        if "filters" in inspect.signature(fn).parameters:
            df = fn(wh, flt)
        elif flt.is_empty:
            df = fn(wh)
        else:
            p.error(f"{args.name} takes no filters")
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
            print(f"{args.name} -> {args.out}")
            return 0
        rows = df.limit(args.limit + 1).collect()
        print("\t".join(df.columns))
        for row in rows[: args.limit]:
            print("\t".join("" if v is None else str(v) for v in row))
        if len(rows) > args.limit:
            print(f"... {df.count() - args.limit} more rows (--limit {args.limit}; --out writes all)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
