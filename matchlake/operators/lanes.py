"""Lane opponents and champion matchups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlake.functions.numeric import percent, rnd

BLUE = 100


def lane_opponents(participants: DataFrame, fields: list[str], place: str = "pos") -> DataFrame:
    """Adds `opponent`: `fields` of the first participant (by place) with the same role on the other side.

    Both sides' first participants are reduced per (match, role) before the shuffle, so a match with very
    many rows never gathers in one task; adaptive execution can split the join on its participant side.
    A missing role is an empty one, and empty roles meet each other.
    """
    role = F.coalesce("role", F.lit(""))
    rows = participants.withColumn("role", role)
    first = F.struct(place, "puuid", *[f for f in fields if f not in (place, "puuid")])
    blue = F.col("teamId") == BLUE
    sides = rows.groupBy("matchId", "role").agg(
        F.min(F.when(blue, first)).alias("first_blue"), F.min(F.when(~blue, first)).alias("first_red")
    )
    joined = rows.join(sides, ["matchId", "role"], "left")
    return joined.withColumn(
        "opponent", F.when(blue, F.col("first_red")).otherwise(F.col("first_blue"))
    ).drop("first_blue", "first_red")


def opponent_among(entries: Column, e: Column) -> Column:
    """The entry of the first participant with the same role on the other side, among a document's entries (p, role).

    As lane_opponents, within one row: who has no team is nobody's opponent, and meets the blue side.
    """
    blue = lambda x: F.coalesce(x["p"]["teamId"] == BLUE, F.lit(False))
    other = lambda x: F.when(blue(e), x["p"]["teamId"] != BLUE).otherwise(blue(x))
    return F.get(F.filter(entries, lambda x: (x["role"] == e["role"]) & other(x)), F.lit(0))


def matchups(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Games and wins per (patch, champion pair, role). The smaller champion id comes first."""
    return (
        pairs.join(matches.select("matchId", "patch"), "matchId")
        .select(
            "patch",
            F.col("position").alias("role"),
            F.least("champion1Id", "champion2Id").alias("championId1"),
            F.greatest("champion1Id", "champion2Id").alias("championId2"),
            # A mirror pair has no second champion: the first side's win counts.
            F.when(F.col("champion1Id") == F.col("champion2Id"), F.col("firstWon"))
            .otherwise(F.col("winnerId") == F.least("champion1Id", "champion2Id"))
            .alias("won1"),
        )
        .groupBy("patch", "role", "championId1", "championId2")
        .agg(F.count("*").alias("gamesPlayed"), F.sum(F.col("won1").cast("long")).alias("champion1Wins"))
    )


def matchup_rates(stats: DataFrame) -> DataFrame:
    wins2 = F.col("gamesPlayed") - F.col("champion1Wins")
    return stats.select(
        "patch",
        "role",
        "championId1",
        "championId2",
        "gamesPlayed",
        "champion1Wins",
        wins2.alias("champion2Wins"),
        rnd(percent("champion1Wins", "gamesPlayed"), 2).alias("winRate1"),
        rnd(percent(wins2, "gamesPlayed"), 2).alias("winRate2"),
    )
