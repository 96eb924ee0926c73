"""Every query against DuckDB on the smallest tables."""

import importlib
from pathlib import Path

import duckdb
import pytest
from millrace.plans import file_queries, queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = queries.QUERIES | file_queries.QUERIES, queries.ORACLE_SQL | file_queries.ORACLE_SQL
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the harness tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    mine, theirs = QUERIES[name](spark, DATA), db.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(tuple, mine.select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)


def test_sorted_pairs_are_in_order(spark):
    keys = [r.key.encode() for r in QUERIES["sorted_pairs"](spark, DATA).collect()]
    assert keys == sorted(keys)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
