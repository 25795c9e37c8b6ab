"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import DATA, rows_of
from fleetlens.plans.registry import all_queries
from fleetlens.sources.tables import TABLES

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(all_queries()) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    out = entry(spark)
    assert out.columns[:2] == ["instance_guid", "check"] and out.select("instance_guid", "check").distinct().count() == 100


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got == want
