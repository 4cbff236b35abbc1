"""Every query that has SQL must equal it on the smallest tables."""

import pytest

from compare import compare, duck
from gyrespark.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
WITH_SQL = [n for n, (_, sql) in QUERIES.items() if sql]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, con, name):
    build, sql = QUERIES[name]
    ok, note = compare(spark, FOLDER, name, build, sql, con)
    assert ok, note


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
