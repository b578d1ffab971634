"""Per-match views: nested detail, event map, item builds, lane comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlake.functions.numeric import per_minute, rnd
from matchlake.functions.timeparts import minute_of
from matchlake.operators import match_parser
from matchlake.operators.champion_stats import with_last_cs, with_match
from matchlake.operators.lanes import lane_opponents

FINAL_ITEMS = 6


def match_detail(docs: DataFrame) -> DataFrame:
    """A match with its teams, by id, and its participants nested: all inside the document's row, nothing moves."""
    teams = F.sort_array(F.transform("info.teams", lambda t: F.struct(*match_parser.team_fields(t))))
    people = match_parser.nested_participants(F.col("info.participants"))
    return match_parser.match_rows(docs.select("*", teams.alias("teams"), people.alias("participants")), "teams", "participants")


def stored_detail(matches: DataFrame, teams: DataFrame, participants: DataFrame) -> DataFrame:
    """The same from stored rows, which lie in tables of their own.

    Both sides are nested on their own, never joined with each other. A match document holds two teams
    and ten participants.
    """
    t = teams.groupBy("matchId").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in teams.columns if c not in ("matchId", "patch")]))).alias("teams")
    )
    names = ["pos", *[c for c in participants.columns if c not in ("matchId", "pos")]]
    p = participants.groupBy("matchId").agg(F.collect_list(F.struct(*names)).alias("participants"))
    by_place = lambda a, b: a["pos"] - b["pos"]
    return (
        matches.join(t, "matchId", "left")
        .join(p, "matchId", "left")
        .withColumn("participants", F.array_sort("participants", by_place))
    )


def position_events(participants: DataFrame, column: str) -> DataFrame:
    """Rows of killPositions or deathPositions with their minute."""
    return participants.select("matchId", "puuid", "championId", F.inline(column)).withColumn(
        "minute", minute_of("timestamp")
    )


def ward_events(participants: DataFrame) -> DataFrame:
    return participants.select("matchId", "puuid", F.inline("wardPositions")).withColumn(
        "minute", minute_of("timestamp")
    )


def objective_events(teams: DataFrame) -> DataFrame:
    """Objectives of all teams; an objective without a team takes its row's team."""
    return teams.select("matchId", F.col("teamId").alias("rowTeam"), F.inline("objectives_timeline")).select(
        "matchId",
        "type",
        "subType",
        F.coalesce("teamId", "rowTeam").alias("teamId"),
        "timestamp",
        minute_of("timestamp").alias("minute"),
        "killerId",
    )


def match_objectives(matches: DataFrame) -> DataFrame:
    """All objectives of the matches, with the team that their event names. No team row is needed for one to be there."""
    return matches.select("matchId", F.inline("objectives")).withColumn("minute", minute_of("timestamp"))


def match_events(participants: DataFrame, matches: DataFrame) -> DataFrame:
    """Kills, deaths, wards and objectives of a match in one table, told apart by `kind`.

    The three participant histories are unpacked from one scan, objectives from the match's own row.
    """
    kind = lambda name, column, ward: F.transform(
        F.coalesce(column, F.array()),
        lambda e: F.struct(
            F.lit(name).alias("kind"),
            e["x"].alias("x"),
            e["y"].alias("y"),
            e["timestamp"].alias("timestamp"),
            (e["wardType"] if ward else F.lit(None).cast("string")).alias("type"),
        ),
    )
    people = (
        participants.select(
            "matchId",
            "puuid",
            "championId",
            F.inline(
                F.concat(
                    kind("kill", F.col("killPositions"), False),
                    kind("death", F.col("deathPositions"), False),
                    kind("ward", F.col("wardPositions"), True),
                )
            ),
        )
        .withColumn("minute", minute_of("timestamp"))
    )
    goals = match_objectives(matches).withColumn("kind", F.lit("objective"))
    return people.unionByName(goals, allowMissingColumns=True)


def item_events(participants: DataFrame) -> DataFrame:
    """Item history in order, minute with one decimal."""
    return participants.select("matchId", "puuid", "championId", F.posexplode("itemTimeline").alias("place", "i")).select(
        "matchId",
        "puuid",
        "championId",
        "place",
        F.col("i.itemId").alias("itemId"),
        F.col("i.timestamp").alias("timestamp"),
        rnd(F.col("i.timestamp") / 60000, 1).alias("minute"),
        F.col("i.type").alias("type"),
    )


def final_build(items: Column) -> Column:
    """Distinct bought items in first-bought order, the last six. Selling does not remove an item."""
    bought = F.array_distinct(
        F.transform(F.filter(F.coalesce(items, F.array()), lambda e: e["type"] == "BUY"), lambda e: e["itemId"])
    )
    return F.slice(bought, F.greatest(F.size(bought) - (FINAL_ITEMS - 1), F.lit(1)), F.lit(FINAL_ITEMS))


def match_builds(participants: DataFrame) -> DataFrame:
    timed = F.transform(
        F.coalesce("itemTimeline", F.array()),
        lambda e: F.struct(
            e["itemId"].alias("itemId"),
            e["timestamp"].alias("timestamp"),
            rnd(e["timestamp"] / 60000, 1).alias("minute"),
            e["type"].alias("type"),
        ),
    )
    return participants.select(
        "matchId",
        "puuid",
        "championId",
        "championName",
        timed.alias("itemTimeline"),
        final_build(F.col("itemTimeline")).alias("finalBuild"),
    )


METRICS = {
    "dpm": ("totalDamage", 1),
    "gpm": ("goldEarned", 1),
    "cspm": ("lastCs", 1),
    "visionScorePerMin": ("visionScore", 2),
    "damageTakenPerMin": ("damageTaken", 1),
}


def player_metrics(games: DataFrame) -> DataFrame:
    """Rounded per-minute metrics of games with gameDuration and lastCs."""
    return games.withColumns({n: rnd(per_minute(c, "gameDuration"), d) for n, (c, d) in METRICS.items()})


def match_performance(participants: DataFrame, matches: DataFrame) -> DataFrame:
    """Metrics of every participant, of the lane opponent, and their comparison (on the rounded values)."""
    games = with_match(with_last_cs(participants), matches, ["gameDuration"])
    fields = ["championId", "role", "kda", *METRICS]
    rows = lane_opponents(player_metrics(games), [f for f in fields if f != "role"])
    own = lambda n: F.col(n)
    other = lambda n: F.col(f"opponent.{n}")

    def share(n: str) -> Column:
        return F.when(other(n) == 0, F.lit(0.0)).otherwise(
            rnd(F.try_divide(own(n) - other(n), other(n)) * 100, 1)
        )

    compared = {}
    for n in ("dpm", "gpm", "cspm"):
        compared[f"{n}Advantage"] = rnd(own(n) - other(n), 1)
        compared[f"{n}AdvantagePercent"] = share(n)
    compared["visionAdvantage"] = rnd(own("visionScorePerMin") - other("visionScorePerMin"), 2)
    compared["survivability"] = rnd(other("damageTakenPerMin") - own("damageTakenPerMin"), 1)
    return rows.select(
        "matchId",
        "puuid",
        "pos",
        *fields,
        F.col("opponent.puuid").alias("opponentPuuid"),
        *[other(n).alias("opponent" + n[0].upper() + n[1:]) for n in fields if n != "role"],
        *[F.when(F.col("opponent").isNotNull(), c).alias(n) for n, c in compared.items()],
    )
