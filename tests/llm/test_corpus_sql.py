import duckdb
import pytest

from revlens.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute(f"create view wanted as {ORACLE_SQL[name]}")
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from wanted").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())
