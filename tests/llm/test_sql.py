"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from rosterforge.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    theirs, mine = c.sql(SQL[name]), QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(x) for x in columns]
    assert sorted(tuple(r[x] for x in columns) for r in mine.collect()) == sorted(tuple(r[k] for k in at) for r in theirs.fetchall())
