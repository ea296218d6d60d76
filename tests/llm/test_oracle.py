import duckdb
import pytest

from driftwell.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in ("conversations", "documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    key = lambda df: sorted(tuple(map(str, r)) for r in df.itertuples(index=False))
    assert key(got) == key(want)


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
