import duckdb
import pytest

from tokenloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "customer part documents benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_its_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.oracles()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert rows(got) == rows(want)
