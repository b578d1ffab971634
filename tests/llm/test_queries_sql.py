"""Queries that SQL can express, against it, over the smallest tables; and what their plans may hold."""

import math
import pathlib

import duckdb
import pytest

from matchlake.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="benchmark tables are not here")


def plain(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(sql.columns)
    if name in ("op3_fingerprints", "op4_licenses", "op7_source_mix"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
    assert plain(df.select(*sql.columns).collect()) == plain(sql.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
