"""Every query that has SQL is run against DuckDB on the same files; the others must give rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from dipstick.catalog import ORACLES, QUERIES
from helpers import rows_of

FOLDER = "/root/testdata/sf0.001"
# Neighbour search and model scoring leave the JVM operators; nothing else does.
WITH_PYTHON = {n for n in QUERIES if n.startswith(("m04_", "j07_"))}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got, "no rows"
    plan = df._jdf.queryExecution().executedPlan().toString()
    banned = ["CartesianProduct", "BroadcastNestedLoopJoin"]
    if name not in WITH_PYTHON:
        banned += ["Python", "InPandas"]
    assert not [word for word in banned if word in plan]
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert rows_of(got, df.columns, order) == rows_of(cursor.fetchall(), names, order)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "refill_date" in df.columns
