"""Registered queries against their SQL twins at the smallest scale, and the shape of their plans."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, bag  # noqa: E402

SF = "/root/testdata/sf0.001"
TWINS = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_sql_twin(spark, db, name):
    df = contract.queries()[name](spark, SF)
    ours = [tuple(r) for r in df.collect()]
    cursor = db.execute(TWINS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, ours) == bag(columns, cursor.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython", plan)


def test_entry_has_a_stable_schema(spark):
    assert contract.entry(spark).columns == ["pid", "course", "ed", "lasted", "nummonthed", "numyeared"]


def test_every_twin_belongs_to_a_query():
    assert set(TWINS) <= set(contract.queries())
