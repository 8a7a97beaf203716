"""Each registered query that has SQL equals what DuckDB computes, on the smallest tables."""

import duckdb
import pytest

from kvasir.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    expected = sorted(map(repr, found.fetchall()))
    out = queries.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in out.select(*columns).collect()) == expected
