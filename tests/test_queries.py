"""Every registered query against its SQL on the smallest tables, and rules its plan has to keep."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as contract
from matchlake.plans import oracle, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="benchmark tables are not here")

QUERIES, SQL = registry.QUERIES, oracle.statements()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def _rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert banned not in plan
    got, wanted = df.toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _rows(got, sorted(got.columns)) == _rows(wanted, sorted(got.columns))


def test_entry(spark):
    assert contract.entry(spark).count() > 0
