"""How the tables are dealt before documents and games are made of them."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import player_stats
from matchlake.plans import registry
from matchlake.sources import star


@pytest.fixture
def tables(spark, tmp_path):
    """6,000 events in 40 files, so that there are more files than cores, and 3,000 lines of 600 orders."""
    i = F.col("id")
    events = spark.range(0, 6000, 1, 40).select(
        i.alias("event_id"), (i * 7 % 50).alias("user_id"), F.get(F.array(*map(F.lit, ("click", "view", "purchase", "signup"))), (i % 4).cast("int")).alias("event_type"),
        (i % 90).cast("double").alias("value"), F.concat(F.lit('{"k": '), (i % 10).cast("string"), F.lit("}")).alias("props"),
        F.timestamp_seconds(1_700_000_000 + i).alias("ts"),
    )
    lines = spark.range(0, 3000, 1, 40).select(
        F.floor(i / 5).alias("l_orderkey"), (i % 200).alias("l_partkey"), F.when(i % 50 != 0, i % 30).alias("l_suppkey"), (i % 5 + 1).cast("int").alias("l_linenumber"),
        (i % 40).cast("double").alias("l_quantity"), (i * 3 % 9000).cast("double").alias("l_extendedprice"), F.when(i % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
    )
    orders = spark.range(600).select(
        i.alias("o_orderkey"), (i % 40).alias("o_custkey"), F.date_add(F.lit("1996-01-01").cast("date"), (i % 700).cast("int")).alias("o_orderdate"),
        F.concat((i % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"),
    )
    for name, rows in {"events": events, "lineitem": lines, "orders": orders}.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def most_in_a_task(rows):
    return max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())


def test_documents_are_made_in_parts_that_follow_the_events(spark, tables, monkeypatch):
    monkeypatch.setattr(star, "EVENT_ROWS", 300, raising=False)
    for made in (star.match_documents, star.timeline_documents):
        docs = made(spark, tables)
        assert docs.count() == 100
        # Twenty parts of five documents on average, where merging by bytes leaves one of a hundred.
        assert most_in_a_task(docs) <= 20


def test_games_are_dealt_into_parts_that_follow_the_lines(spark, tables, monkeypatch):
    monkeypatch.setattr(star, "LINE_ROWS", 150, raising=False)
    partials = registry.star_partials(spark, tables)
    left_alone = player_stats.player_partials_of(star.participants(spark, tables), star.matches(spark, tables), False)
    assert most_in_a_task(partials) <= left_alone.count() / 4
    assert sorted(map(str, partials.collect())) == sorted(map(str, left_alone.collect()))
    # What groups by player and champion keeps to the parts; only the ranking within a player moves rows.
    plan = player_stats.top_champions(partials)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") <= 2
