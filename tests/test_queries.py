"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    res = con.execute(ORACLES[key])
    want = table([d[0] for d in res.description], res.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
