"""The queries that SQL can express, each against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sheaf.llm import queries

SF = os.environ.get("SHEAF_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_and_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = connection.sql(queries.ORACLE_SQL[name])
    columns = list(want.columns)
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
