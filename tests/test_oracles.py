"""Every registered query against DuckDB on the smallest tables; the rest must at least run."""

import os

import pytest

import oracle
from trackloom.plans.catalog import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, FOLDER)
    if q.sql is None:
        df.collect()
        return
    same, message = oracle.compare(df, con, q.sql)
    assert same, message
