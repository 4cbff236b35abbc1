"""Registered queries: SQL where there is some, a full result for every input row elsewhere."""

import duckdb
import pytest

from compare import compare, duck
from gyrespark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    build, sql = QUERIES[name]
    if sql:
        ok, note = compare(spark, FOLDER, name, build, sql, duck(FOLDER))
        assert ok, note
    else:
        ids = [r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/documents.parquet' ORDER BY 1").fetchall()]
        assert sorted(r.doc_id for r in build(spark, FOLDER).select("doc_id").collect()) == ids


def test_names():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
