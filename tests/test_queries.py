"""Every registered query against its SQL twin on the smallest scale."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

#: The text operators and the pipeline have tests of their own.
QUERIES = {k: q for k, q in queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLES = {k: q for k, q in oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    result = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert result.startswith("equal") and "TYPES" not in result, result


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r["class"] for r in sorted(rows)] == list(range(1, 9))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"head_logreg", "head_mlp", "head_pca"}))
def test_no_cross_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
