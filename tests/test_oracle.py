"""Every registered query against its SQL, on the smallest tables."""

import collections
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as driver  # noqa: E402
from httplens import acceptance  # noqa: E402
from httplens.acceptance import oracle, queries  # noqa: E402,F401

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = acceptance.queries.queries(), acceptance.oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_the_driver_gets_them_all():
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    place = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(place) == columns
    want = collections.Counter(tuple(r[place[c]] for c in columns) for r in cursor.fetchall())
    assert got == want and want


def test_entry(spark):
    assert driver.entry(spark).count() == 28
