"""Per-player and per-player-champion aggregates.

One pass over the games gives partial sums per (player, champion, role, patch, queue). Everything else, the
lifetime row 'ALL' included, is rolled up from those much smaller rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlake.functions.numeric import at_or_zero, kda, mean_of_micros, micros, percent, rnd
from matchlake.functions.patches import ALL_PATCHES
from matchlake.operators.champion_stats import RATES, game_rows, merge, shared_sums, with_last_cs
from matchlake.operators.lanes import lane_opponents

PLAYER_KEYS = ["puuid", "patch", "queueId"]
PLAYER_CHAMPION_KEYS = ["puuid", "championId", "patch", "queueId"]
PARTIAL_KEYS = ["puuid", "championId", "role", "patch", "queueId"]
LANING_MINUTE = 15
SOLO = ["soloKills15", "soloDeaths15"]
LANING = {"csd15": "csGraph", "gd15": "goldGraph", "xpd15": "xpGraph"}


def with_laning(participants: DataFrame) -> DataFrame:
    """Adds `hasOpponent` and the differences at minute 15, null without a lane opponent. Stored participants have them."""
    if "hasOpponent" in participants.columns:
        return participants
    at15 = {f"_{name}": at_or_zero(series, LANING_MINUTE).cast("long") for name, series in LANING.items()}
    joined = lane_opponents(with_last_cs(participants.withColumns(at15)), list(at15))
    diffs = {name: F.col(f"_{name}") - F.col(f"opponent._{name}") for name in LANING}
    return joined.withColumns({"hasOpponent": F.col("opponent").isNotNull(), **diffs}).drop("opponent", *at15)


def game_sums(columns: list[str], games: Column | None = None) -> list:
    """Partial sums over rows of champion_stats.game_rows with laning columns; without solo fights where there are none."""
    return [
        *shared_sums(games),
        F.sum("visionScore").cast("long").alias("visionSum"),
        F.sum(F.col("hasOpponent").cast("long")).alias("opponentGames"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(f"{name}Sum") for name in LANING],
        *[(F.coalesce(F.sum(name), F.lit(0)) if name in columns else F.lit(0)).cast("long").alias(f"{name}Sum") for name in SOLO],
        F.max("gameCreation").alias("lastPlayedAt"),
    ]


def player_partials(games: DataFrame) -> DataFrame:
    """`games` are rows of champion_stats.game_rows over participants with laning columns."""
    return games.groupBy(*PARTIAL_KEYS).agg(*game_sums(games.columns))


def with_lifetime(partials: DataFrame, patch: str | None = None) -> DataFrame:
    """Every row once for its patch and once for the lifetime patch, or only for the patch that is asked for."""
    if patch == ALL_PATCHES:
        return partials.withColumn("patch", F.lit(ALL_PATCHES))
    if patch is not None:
        return partials.where(F.col("patch") == patch)
    return partials.withColumn("patch", F.explode(F.array("patch", F.lit(ALL_PATCHES))))


def rates() -> list:
    """The rates that partial sums give, rounded."""
    return [
        "gamesPlayed",
        "wins",
        (F.col("gamesPlayed") - F.col("wins")).alias("losses"),
        rnd(percent("wins", "gamesPlayed"), 2).alias("winRate"),
        rnd(mean_of_micros("kdaMicros", "gamesPlayed"), 2).alias("avgKda"),
        *[rnd(mean_of_micros(f"{r}Micros", "timedGames"), 2).alias(f"avg{r.capitalize()}") for r in RATES],
        rnd(F.try_divide(F.col("visionSum").cast("double"), "gamesPlayed"), 2).alias("avgVisionScore"),
        *[F.col(f"{name}Sum").alias(name) for name in SOLO],
    ]


def player_stats(partials: DataFrame, patch: str | None = None) -> DataFrame:
    """Rates per player, of every patch and the lifetime or of one."""
    return merge(with_lifetime(partials.drop("championId", "role"), patch), PLAYER_KEYS).select(
        *PLAYER_KEYS, *rates(), F.col("lastPlayedAt")
    )


def laning_rates() -> list:
    """Mean differences at minute 15 over the games with an opponent."""
    mean = lambda n: F.coalesce(F.try_divide(F.col(f"{n}Sum").cast("double"), "opponentGames"), F.lit(0.0))
    return [rnd(mean(n), 2).alias(f"avg{n.capitalize()}") for n in LANING]


def _roles(pairs: Column) -> Column:
    """Role to games map of a short list of (role, games)."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["role"])))
    total = lambda r: F.aggregate(F.filter(pairs, lambda p: p["role"] == r), F.lit(0).cast("long"), lambda n, p: n + p["games"])
    return F.map_from_arrays(names, F.transform(names, total))


def _role_pairs() -> Column:
    return F.collect_list(F.struct("role", F.col("gamesPlayed").alias("games"))).alias("_roles")


def summaries(partials: DataFrame, patch: str, name: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """Rates, roles and the k most played champions of each player in one patch, or in the lifetime.

    Games are added up once per player and champion, and those rows once per player: the lists that meet there are a
    player's champions, with a few roles each. `name` adds championName to rows with a championId.
    """
    champions_ = merge(with_lifetime(partials, patch), PLAYER_CHAMPION_KEYS, _role_pairs())
    best = F.struct((-F.col("gamesPlayed")).alias("order"), "championId", "championName", F.col("gamesPlayed").alias("games"), "wins")
    people = merge(name(champions_), PLAYER_KEYS, F.flatten(F.collect_list("_roles")).alias("_roles"), F.sort_array(F.collect_list(best)).alias("_best"))
    top = F.transform(
        F.slice("_best", 1, k),
        lambda c: F.struct(c["championId"].alias("championId"), c["championName"].alias("championName"), c["games"].alias("games"), rnd(percent(c["wins"], c["games"]), 2).alias("winRate")),
    )
    return people.select(*PLAYER_KEYS, *rates(), "lastPlayedAt", _roles(F.col("_roles")).alias("roleDistribution"), top.alias("topChampions"))


def player_champion_stats(partials: DataFrame, patch: str | None = None, roles: bool = False) -> DataFrame:
    """Rates and laning per player and champion, of every patch and the lifetime or of one; with the role map if asked for."""
    rows = with_lifetime(partials if roles else partials.drop("role"), patch)
    merged = merge(rows, PLAYER_CHAMPION_KEYS, *([_role_pairs()] if roles else []))
    shown = [_roles(F.col("_roles")).alias("roleDistribution")] if roles else []
    return merged.select(*PLAYER_CHAMPION_KEYS, *rates(), *laning_rates(), "lastPlayedAt", *shown)


def role_counts(partials: DataFrame, keys: list[str] = PLAYER_KEYS) -> DataFrame:
    """Games per role below each key."""
    return (
        with_lifetime(partials.select("role", "gamesPlayed", *[k for k in {*keys, "patch"}]))
        .groupBy(*keys, "role")
        .agg(F.sum("gamesPlayed").alias("games"))
    )


def role_distribution(partials: DataFrame, keys: list[str] = PLAYER_KEYS) -> DataFrame:
    """Role to games map. There are only a handful of roles, so the map stays small."""
    return role_counts(partials, keys).groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "games")))).alias("roleDistribution")
    )


def top_champions(partials: DataFrame, k: int = 5) -> DataFrame:
    """The k most played champions of a player, best first; ties by champion id."""
    counts = (
        with_lifetime(partials.select(*PLAYER_CHAMPION_KEYS, "gamesPlayed", "wins"))
        .groupBy(*PLAYER_CHAMPION_KEYS)
        .agg(F.sum("gamesPlayed").alias("games"), F.sum("wins").alias("wins"))
    )
    w = Window.partitionBy(*PLAYER_KEYS).orderBy(F.desc("games"), "championId")
    return (
        counts.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= k)
        .select(*PLAYER_KEYS, "place", "championId", "games", rnd(percent("wins", "games"), 2).alias("winRate"))
    )


def without_laning(participants: DataFrame) -> DataFrame:
    """The laning columns left empty, for reports that do not show them: saves the search for the opponent."""
    none = {name: F.lit(None).cast("long") for name in LANING}
    return with_last_cs(participants).withColumns({"hasOpponent": F.lit(False), **none})


def player_partials_of(participants: DataFrame, matches: DataFrame, laning: bool = True, parts: int | None = None) -> DataFrame:
    """With parts the games are dealt into so many by player and champion, which all groupings that name both keep to: few games
    share a partial sum, so there is little to reduce before the shuffle, and what a task holds does not grow with the table."""
    games = game_rows(with_laning(participants) if laning else without_laning(participants), matches)
    return player_partials(games.repartition(parts, "puuid", "championId") if parts else games)


def role_report(games: DataFrame) -> DataFrame:
    """Games, share, wins and kda per player and role over the given games; `place` orders a player's roles by games."""
    counts = games.groupBy("puuid", "role").agg(
        F.count("*").alias("gamesPlayed"),
        F.sum(F.col("win").cast("long")).alias("wins"),
        F.sum(micros(kda("kills", "deaths", "assists"))).alias("kdaMicros"),
    )
    total = F.sum("gamesPlayed").over(Window.partitionBy("puuid"))
    order = Window.partitionBy("puuid").orderBy(F.desc("gamesPlayed"), "role")
    return counts.withColumns({"totalGames": total, "place": F.row_number().over(order)}).select(
        "puuid",
        "place",
        "role",
        "gamesPlayed",
        rnd(percent("gamesPlayed", "totalGames"), 2).alias("percentage"),
        "wins",
        (F.col("gamesPlayed") - F.col("wins")).alias("losses"),
        rnd(percent("wins", "gamesPlayed"), 2).alias("winRate"),
        rnd(mean_of_micros("kdaMicros", "gamesPlayed"), 2).alias("avgKda"),
        "totalGames",
    )
