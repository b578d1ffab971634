"""Readers of the landed documents. Each takes a path (or paths) and returns a typed DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchlake.sources import schemas


def read_matches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.MATCH).option("multiLine", multi_line).json(path)


def read_timelines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.TIMELINE).option("multiLine", multi_line).json(path)


def parse_json(df: DataFrame, schema, value: str = "value") -> DataFrame:
    """Typed columns from one column of JSON text, for documents landed as rows instead of files."""
    return df.select(F.from_json(value, schema).alias("doc")).select("doc.*")


def read_champions_file(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object keyed by champion name. One row per champion."""
    data = spark.read.schema(schemas.CHAMPIONS_FILE).option("multiLine", True).json(path)
    return champions_from_file(data)


def champions_from_file(data: DataFrame) -> DataFrame:
    return data.select(F.explode("data").alias("file_key", "c")).select(
        F.col("c.key").try_cast("int").alias("championId"),
        F.col("c.id").alias("id"),
        F.col("c.name").alias("name"),
        F.col("c.title").alias("title"),
        F.col("c.version").alias("version"),
    )


def read_league(spark: SparkSession, path: str) -> DataFrame:
    return explode_league(spark.read.schema(schemas.LEAGUE_LIST).option("multiLine", True).json(path))


def explode_league(leagues: DataFrame) -> DataFrame:
    """One row per entry; the tier of the list stands in for entries without one."""
    return leagues.select("tier", F.explode("entries").alias("e")).select(
        F.col("e.puuid").alias("puuid"),
        F.coalesce("e.tier", "tier").alias("tier"),
        F.col("e.queueType").alias("queueType"),
        F.col("e.rank").alias("rank"),
        F.col("e.leaguePoints").alias("leaguePoints"),
        F.col("e.wins").alias("wins"),
        F.col("e.losses").alias("losses"),
    )


def read_ranked_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RANKED_ENTRIES).json(path)


def read_match_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MATCH_IDS).json(path)


def take_match_ids(lists: DataFrame, count: int = 20, start: int = 0) -> DataFrame:
    """(puuid, matchId) for list places start .. start+count-1; lists are newest first."""
    return (
        lists.select("puuid", F.posexplode("ids").alias("place", "matchId"))
        .where(F.col("place").between(start, start + count - 1))
        .select("puuid", "place", "matchId")
    )


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VERSIONS).json(path)


def longs_as_text(df: DataFrame) -> DataFrame:
    """Long values as strings at every depth, the form the JSON output uses."""
    return df.select(*[_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _text(c, t):
    from pyspark.sql import types as T

    if isinstance(t, T.LongType):
        return c.cast("string")
    if isinstance(t, T.StructType):
        made = F.struct(*[_text(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _text(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _text(v, t.valueType))
    return c


def write_json(df: DataFrame, path: str) -> None:
    longs_as_text(df).write.mode("overwrite").json(path)
