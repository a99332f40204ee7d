"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as registered
from hunkwise.plans import catalog

# The training-data queries have tests of their own.
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES

# Per-row Python runs only where a user brings a model, and in Spark's own ML glue.
PYTHON = {"score_batch", "score_quarantine"}
WRITES_TABLES = {name for name in QUERIES if name.startswith("stream_")} | {
    "scan_deliveries", "snippet_bus_roundtrip", "dataset_split", "training_history",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    return con


def normal(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoop"):
        assert bad not in plan
    if name not in PYTHON:
        assert not re.search(r"(MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython)", plan)
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    expected = [tuple(row[i] for i in order) for row in found.fetchall()]
    assert normal(rows) == normal(expected)


def test_names(spark):
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(registered.queries()) and set(registered.oracle_sql()) <= set(registered.queries())
    assert set(QUERIES) - set(SQL) == {"score_ml", "training_history"}


def test_entry(spark):
    assert registered.entry(spark).count() > 0
