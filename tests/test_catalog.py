import duckdb
import pytest

from quarryline.plans import catalog, lineage_queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | lineage_queries.QUERIES, catalog.ORACLES | lineage_queries.ORACLES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "supplier", "part", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(*want.columns).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
