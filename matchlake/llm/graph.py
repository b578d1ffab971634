"""Connected groups of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of an edge reaches.

    Each round every node hands its smallest neighbour to its larger neighbours, then to its smaller ones, which halves
    the way to the smallest and ends in stars. Only sums, joins on a node and one row for each edge: no group is
    gathered, and a node with very many neighbours is summed before the shuffle and split by the join. Each round is
    written to the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = written(now, "edges"), None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.withColumn("component", F.col("node")))


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: each node links its larger neighbours to the smallest among itself and its neighbours."""
    # The smallest neighbour of u is below it; a node without one is its own smallest.
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    joined = edges.join(least, edges["v"] == least["w"], "left")
    return joined.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    rest = edges.join(least, edges["u"] == least["w"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
