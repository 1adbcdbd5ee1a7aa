"""Every registered query against its independent DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from revlens.plans.catalog import all_queries
from tools.oracle_sql import ORACLE_SQL

SF = os.environ.get("REVLENS_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def canon(rows, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    cols = sorted(sdf.columns)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    con.execute(f"CREATE OR REPLACE VIEW wanted AS {ORACLE_SQL[key]}")  # SQL must also do as a view
    cur = con.execute("SELECT * FROM wanted")
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert canon(srows, cols) == canon(drows, cols)
