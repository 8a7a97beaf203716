"""The driver's contract: the queries run, and equal their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
PLAIN = {n: q for n, q in __import__("kvasir.plans.registry", fromlist=["x"]).queries().items()}
ORACLE = __import__("kvasir.plans.registry", fromlist=["x"]).oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{D}/{t}'")
    return con


def normal(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return x


def test_entry(spark):
    assert len(entry.entry(spark).columns) > 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in PLAIN if n in ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = PLAIN[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    mine = sorted(repr([normal(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([normal(r[i]) for i in at]) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(n for n in PLAIN if n not in ORACLE and n != "community_hierarchy"))
def test_query_without_sql_runs(spark, name):
    assert PLAIN[name](spark, D).count() > 0
