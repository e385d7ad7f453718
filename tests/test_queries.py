"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from rosterforge import more_queries, queries, state_queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    theirs = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(theirs.columns)
    columns = sorted(df.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert plain([tuple(r[c] for c in columns) for r in df.collect()]) == plain([tuple(r[i] for i in at) for r in theirs.fetchall()])


@pytest.mark.parametrize("name", ["q05_duplicates_flagged", "q06_merge_by_email", "q19_load_outcomes", "q27_retry_set"])
def test_order_of_rows_does_not_matter(spark, name, monkeypatch):
    first = plain(tuple(r) for r in queries.QUERIES[name](spark, SF).collect())
    whole = queries.table
    monkeypatch.setattr(queries, "table", lambda s, d, t: whole(s, d, t).repartition(5))
    assert plain(tuple(r) for r in queries.QUERIES[name](spark, SF).collect()) == first


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
