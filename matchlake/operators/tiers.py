"""Scored and ranked champion tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from matchlake.functions import scoring
from matchlake.functions.numeric import rnd
from matchlake.functions.patches import previous_patch
from matchlake.operators.catalog import champion_list

SORTABLE = ["winRate", "banRate", "pickRate", "gamesPlayed", "kda", "dpm", "gpm", "cspm", "rank"]
MAX_PAGE = 200


def with_scores(stats: DataFrame, padded: bool = False, last_minor: int = 23) -> DataFrame:
    """Adds score, tier and the too-few-games flag, using the champion's row of the patch before.

    The statistics are read once: patches are numbered so that the one before has the number before, and of the rows
    there, a few at most, the one of the wanted name counts.
    """
    parts = F.split("patch", r"\.")
    major, minor = (F.get(parts, F.lit(i)).try_cast("long") for i in (0, 1))
    there = Window.partitionBy("championId", "queueId").orderBy("_number").rangeBetween(-1, -1)
    numbered = stats.withColumn("_before", previous_patch("patch", padded, last_minor)).withColumn("_number", major * last_minor + minor)
    listed = numbered.withColumn("_listed", F.collect_list(F.struct("patch", *scoring.METRICS)).over(there))
    joined = listed.withColumn("_old", F.get(F.filter("_listed", lambda x: x["patch"] == F.col("_before")), F.lit(0)))
    now = {m: F.col(m) for m in scoring.METRICS}
    old = {m: F.col(f"_old.{m}") for m in scoring.METRICS}
    few = F.col("gamesPlayed") < scoring.MIN_GAMES
    return (
        joined.withColumn("score", scoring.champion_score(now, old))
        .withColumn("hasInsufficientData", few)
        .withColumn(
            "tier",
            F.when(few, F.lit(scoring.INSUFFICIENT)).otherwise(
                scoring.tier(F.col("score"), F.col("winRate"), F.col("banRate"))
            ),
        )
        .drop("_before", "_number", "_listed", "_old")
    )


def with_ranks(scored: DataFrame) -> DataFrame:
    """Place by score among champions with enough games of a patch and queue; the others have none."""
    w = Window.partitionBy("patch", "queueId", "hasInsufficientData").orderBy(F.desc("score"), "championId")
    return scored.withColumn("rank", F.when(~F.col("hasInsufficientData"), F.row_number().over(w)))


def known_champions(stats: DataFrame, catalog: DataFrame, version: str | None = None) -> DataFrame:
    info = champion_list(catalog, version).select("championId", F.col("name").alias("championName"), "images")
    return stats.join(info, "championId")


def rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {m: rnd(m, 2) for m in ["winRate", "kda", "dpm", "cspm", "gpm", "banRate", "pickRate"]}
    )


def sort_page(
    rows: DataFrame, sort_by: str = "winRate", order: str = "desc", page: int = 1, limit: int = 20
) -> DataFrame:
    """One page in the given order; missing values sort as 0, ties by champion."""
    if sort_by not in SORTABLE:
        raise ValueError(f"sort_by is one of {SORTABLE}")
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit is 1 to {MAX_PAGE}")
    key = F.coalesce(sort_by, F.lit(0))
    ordered = rows.orderBy(F.desc(key) if order == "desc" else F.asc(key), "championId")
    return ordered.offset((page - 1) * limit).limit(limit)
