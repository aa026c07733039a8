"""Every registered query with SQL gives the rows of its SQL, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__

SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def rows(table, names):
    return sorted(repr([None if v != v else v for v in r]) for r in zip(*(table[n] for n in names), strict=True))


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op")])
def test_query_equals_sql(spark, sf, duck, name):
    got = __spark_entry__.queries()[name](spark, sf).toArrow().to_pydict()
    done = duck.execute(SQL[name])
    names = [d[0] for d in done.description]
    found = done.fetchall()
    want = {n: [r[k] for r in found] for k, n in enumerate(names)}
    assert sorted(got) == sorted(want)
    assert rows(got, sorted(got)) == rows(want, sorted(got))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
