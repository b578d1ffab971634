"""Per-champion aggregates: mergeable partial sums, and the rates read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from matchlake.functions.numeric import kda, last_or_zero, mean_of_micros, micros, per_minute, percent

RATES = ["dpm", "gpm", "cspm"]
CHAMPION_KEYS = ["championId", "patch", "queueId"]
CHAMPION_SUMS = ["gamesPlayed", "timedGames", "wins", "kdaMicros", "dpmMicros", "gpmMicros", "cspmMicros"]


MATCH_COLUMNS = ["patch", "queueId", "gameVersion", "gameCreation", "gameDuration"]
SERIES = ["goldGraph", "xpGraph", "csGraph", "damageGraph"]


def with_last_cs(participants: DataFrame) -> DataFrame:
    """Keeps the one value of the series the rates need, so that no series travels through a shuffle."""
    if "lastCs" in participants.columns:
        return participants
    return participants.withColumn("lastCs", last_or_zero("csGraph")).drop(*SERIES)


def with_match(participants: DataFrame, matches: DataFrame, names: list[str] = MATCH_COLUMNS) -> DataFrame:
    """Participants with match columns. Stored participants carry them already and are not joined again."""
    missing = [n for n in names if n not in participants.columns]
    return participants.join(matches.select("matchId", *missing), "matchId") if missing else participants


def game_rows(participants: DataFrame, matches: DataFrame) -> DataFrame:
    """Participants, without series, with the match columns every aggregate needs and their per-minute rates."""
    return with_rates(with_match(with_last_cs(participants), matches))


def with_rates(games: DataFrame) -> DataFrame:
    return games.withColumns(
        {
            "kda": kda("kills", "deaths", "assists"),
            "dpm": per_minute("totalDamage", "gameDuration"),
            "gpm": per_minute("goldEarned", "gameDuration"),
            "cspm": per_minute("lastCs", "gameDuration"),
        }
    )


def shared_sums(games: Column | None = None) -> list:
    """Games (all rows, unless a count is given), wins and rate sums. A zero duration has no rates but still counts as a game."""
    return [
        (F.count("*") if games is None else games).alias("gamesPlayed"),
        F.count("dpm").alias("timedGames"),
        F.sum(F.col("win").cast("long")).alias("wins"),
        F.sum(micros("kda")).alias("kdaMicros"),
        *[F.coalesce(F.sum(micros(r)), F.lit(0)).alias(f"{r}Micros") for r in RATES],
    ]


def champion_partials(games: DataFrame) -> DataFrame:
    return games.groupBy(*CHAMPION_KEYS).agg(*shared_sums())


def ban_partials(teams: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of a patch and queue that ban a champion; two bans in one match count once."""
    banned = teams.select("matchId", F.explode("bans").alias("championId")).distinct()
    return (
        banned.join(matches.select("matchId", "patch", "queueId"), "matchId")
        .groupBy(*CHAMPION_KEYS)
        .agg(F.count("*").alias("bans"))
    )


def match_partials(matches: DataFrame) -> DataFrame:
    return matches.groupBy("patch", "queueId").agg(F.count("*").alias("matches"))


def merge(partials: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Adds up partial rows of the same key, with more aggregates beside. Sums are exact, so the split into parts does not matter."""
    sums = [c for c in partials.columns if c not in keys and not c.startswith("last") and isinstance(partials.schema[c].dataType, NumericType)]
    lasts = [c for c in partials.columns if c.startswith("last")]
    return partials.groupBy(*keys).agg(
        *[F.sum(c).cast(partials.schema[c].dataType).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in lasts],
        *more,
    )


def champion_stats(partials: DataFrame, bans: DataFrame, matches: DataFrame) -> DataFrame:
    """Rates per champion, patch and queue, with pick and ban rates over the matches of that patch and queue."""
    return (
        partials.join(matches, ["patch", "queueId"], "left")
        .join(bans, CHAMPION_KEYS, "left")
        .select(
            *CHAMPION_KEYS,
            "gamesPlayed",
            "wins",
            (F.col("gamesPlayed") - F.col("wins")).alias("losses"),
            percent("wins", "gamesPlayed").alias("winRate"),
            mean_of_micros("kdaMicros", "gamesPlayed").alias("kda"),
            *[mean_of_micros(f"{r}Micros", "timedGames").alias(r) for r in RATES],
            percent(F.coalesce("bans", F.lit(0)), "matches").alias("banRate"),
            percent("gamesPlayed", "matches").alias("pickRate"),
        )
    )


def champion_stats_of(participants: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    return champion_stats(
        champion_partials(game_rows(participants, matches)), ban_partials(teams, matches), match_partials(matches)
    )


def champion_totals(participants: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Plain sums per patch and champion, with the number of bans."""
    m = matches.select("matchId", "patch")
    played = (
        with_match(with_last_cs(participants), matches, ["patch", "gameDuration"])
        .groupBy("patch", "championId")
        .agg(
            F.count("*").alias("gamesPlayed"),
            F.sum("kills").alias("totalKills"),
            F.sum("deaths").alias("totalDeaths"),
            F.sum("assists").alias("totalAssists"),
            F.sum("lastCs").alias("totalCs"),
            F.sum("totalDamage").alias("totalDamage"),
            F.sum("goldEarned").alias("totalGold"),
            F.sum("gameDuration").alias("totalDuration"),
        )
    )
    banned = (
        teams.select("matchId", F.explode("bans").alias("championId"))
        .join(m, "matchId")
        .groupBy("patch", "championId")
        .agg(F.count("*").alias("totalBans"))
    )
    return played.join(banned, ["patch", "championId"], "left").withColumn(
        "totalBans", F.coalesce("totalBans", F.lit(0))
    )


def primary_roles(games: DataFrame) -> DataFrame:
    """Role a champion is played in most per patch; the alphabetically first on equal counts."""
    counts = games.groupBy("championId", "patch", "role").agg(F.count("*").alias("roleGames"))
    w = Window.partitionBy("championId", "patch").orderBy(F.desc("roleGames"), "role")
    return (
        counts.withColumn("place", F.row_number().over(w))
        .where("place = 1")
        .select("championId", "patch", F.col("role").alias("primaryRole"), "roleGames")
    )
