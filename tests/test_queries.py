"""Registered queries of the library against their SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__
from factloom.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def values(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert values(rows, df.columns) == values(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
