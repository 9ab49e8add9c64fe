"""Registered queries against their SQL on DuckDB, every one of them."""

import os

import pytest
from check_oracle import connect, table

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[2]
        return
    cursor = connect(FOLDER).execute(sql)
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())
