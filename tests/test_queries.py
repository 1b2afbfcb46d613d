"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallyspark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES = catalogue.queries()
ORACLES = catalogue.oracle_sql()
# writing the text of a plan does not need the run of a stream or a written table
LAZY = [n for n in QUERIES if not n.startswith(("st", "k01", "k02", "k05", "k07", "k11", "s10", "s12", "j15", "full"))]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def order(row):
    return tuple((v is None, "" if v is None else str(type(v)), 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in result.collect()), key=order)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in cursor.fetchall()), key=order)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(LAZY))
def test_plan_has_no_cross_join_and_no_hint(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "strategy=broadcast"):
        assert unwanted not in plan
    if not name.startswith("v01"):
        assert "Python" not in plan and "MapInPandas" not in plan


def test_only_the_approximate_search_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"v02_nearest_approximate"}


def test_entry(spark):
    assert entry_points.entry(spark).count() == 150
