"""Every query with SQL is held against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from sievework.plans import queries as plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 6)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(row[k]) for k in order) for row in data), key=repr)


def test_every_query_is_named_once():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    made = QUERIES[name](spark, SF)
    got = rows(made.columns, [tuple(row) for row in made.collect()])
    found = duck.execute(SQL[name])
    columns = [part[0] for part in found.description]
    want = rows(columns, found.fetchall())
    assert sorted(made.columns) == sorted(columns)
    assert got == want
