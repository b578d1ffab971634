"""Match documents to match, team and participant rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlake.functions import numeric, patches, text
from matchlake.functions.nested import bound
from matchlake.sources import schemas


def match_rows(docs: DataFrame, *more: str) -> DataFrame:
    """One row per match; with a column `objectives` (the match's objective list) that stays, whatever its teams are, and so do
    the columns that are named."""
    return docs.select(
        F.col("metadata.matchId").alias("matchId"),
        F.col("info.gameCreation").alias("gameCreation"),
        F.col("info.gameDuration").alias("gameDuration"),
        F.col("info.gameMode").alias("gameMode"),
        F.col("info.queueId").alias("queueId"),
        F.col("info.gameVersion").alias("gameVersion"),
        F.col("info.mapId").alias("mapId"),
        F.lit(True).alias("hasTimeline"),
        patches.extract_patch("info.gameVersion").alias("patch"),
        *[c for c in docs.columns if c == "objectives" or c in more],
    )


def team_rows(docs: DataFrame) -> DataFrame:
    """One row per team; documents without teams give none.

    With a column `objectives` (the match's objective list) each team also gets its own part of it.
    """
    timed = "objectives" in docs.columns
    extra = [F.col("objectives")] if timed else []
    rows = docs.select(
        F.col("metadata.matchId").alias("matchId"),
        patches.extract_patch("info.gameVersion").alias("patch"),
        F.explode("info.teams").alias("t"),
        *extra,
    )
    own = F.filter("objectives", lambda o: o["teamId"] == F.col("t.teamId"))
    return rows.select("matchId", "patch", *team_fields(F.col("t")), *([own.alias("objectives_timeline")] if timed else []))


def team_fields(t: Column) -> list[Column]:
    return [t["teamId"].alias("teamId"), t["win"].alias("win"), banned_ids(t["bans"]).alias("bans"), t["objectives"].alias("objectives_summary")]


def banned_ids(bans: Column) -> Column:
    """Champion ids of a ban list without the empty picks."""
    ids = F.filter(F.transform(bans, lambda b: b["championId"]), lambda i: i > 0)
    return F.coalesce(ids, F.array().cast("array<int>"))


def match_bans(teams: DataFrame) -> DataFrame:
    """One row per banned champion of a match, over all teams."""
    return teams.select("matchId", F.explode("bans").alias("championId"))


def _raw_participants(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("metadata.matchId").alias("matchId"), F.posexplode("info.participants").alias("pos", "raw")
    )


def _typed(raw: DataFrame) -> DataFrame:
    """Parses the text of single participants (column raw): declared properties, unless p holds them, and all as a map."""
    typed = raw if "p" in raw.columns else raw.withColumn("p", F.from_json("raw", schemas.PARTICIPANT))
    return typed.withColumn("props", F.from_json("raw", "map<string,string>")).drop("raw")


def role_of(p: Column) -> Column:
    return text.first_filled(p["teamPosition"], p["individualPosition"])


def pings_of(props: Column) -> Column:
    """Numeric properties whose name ends in `Pings`."""
    numeric_ones = F.map_filter(props, lambda k, v: k.endswith("Pings") & v.try_cast("int").isNotNull())
    return F.transform_values(numeric_ones, lambda k, v: v.cast("int"))


def participant_rows(docs: DataFrame) -> DataFrame:
    """One row per participant, with its place in the document."""
    return participants_of(_raw_participants(docs))


def participants_of(raw: DataFrame) -> DataFrame:
    """Participant rows from (matchId, pos, raw), and p where raw is parsed already; further columns stay."""
    rest = [c for c in raw.columns if c not in ("matchId", "pos", "raw", "p")]
    return _typed(raw).select("matchId", "pos", *participant_fields(F.col("p"), F.col("props")), *rest)


def participant_fields(p: Column, props: Column) -> list[Column]:
    """The columns of a participant, from its declared properties and all of them as a map."""
    own = lambda *names: [p[n].alias(n) for n in names]
    return [
        *own("puuid", "summonerName", "championId", "championName", "teamId"),
        role_of(p).alias("role"),
        text.first_filled(p["lane"], p["individualPosition"]).alias("lane"),
        *own("win", "kills", "deaths", "assists"),
        numeric.kda(p["kills"], p["deaths"], p["assists"]).alias("kda"),
        p["goldEarned"].alias("goldEarned"),
        p["totalDamageDealtToChampions"].alias("totalDamage"),
        p["totalDamageTaken"].alias("damageTaken"),
        F.coalesce(p["visionScore"], F.lit(0)).alias("visionScore"),
        p["perks"].alias("runes"),
        p["challenges"].alias("challenges"),
        pings_of(props).alias("pings"),
        F.array(p["summoner1Id"], p["summoner2Id"]).alias("spells"),
    ]


def nested_participants(raws: Column) -> Column:
    """The participants of a document as an array of participant_rows' columns, in its order."""

    def entry(raw, pos):
        parsed = F.struct(F.from_json(raw, schemas.PARTICIPANT).alias("p"), F.from_json(raw, "map<string,string>").alias("props"))
        return bound(parsed, lambda x: F.struct(pos.alias("pos"), *participant_fields(x["p"], x["props"])))

    return F.transform(raws, entry)


def slim_participants(docs: DataFrame) -> DataFrame:
    """Reduced participant rows; the position is the individual one."""
    names = [
        "puuid", "championId", "championName", "teamId", "win", "kills", "deaths", "assists",
        "totalDamageDealtToChampions", "totalMinionsKilled", "neutralMinionsKilled", "goldEarned",
    ]
    return _typed(_raw_participants(docs)).select(
        "matchId",
        "pos",
        F.col("p.individualPosition").alias("position"),
        *[F.col(f"p.{n}").alias(n) for n in names],
    )


def match_outcomes(docs: DataFrame) -> DataFrame:
    """Patch, duration and winning team (team of the first winner, 0 without one) of each match, all from its own row."""
    first = F.get(F.filter("info.participants", lambda p: F.get_json_object(p, "$.win") == "true"), F.lit(0))
    team = F.get_json_object(first, "$.teamId").try_cast("int")
    return docs.select(
        F.col("metadata.matchId").alias("matchId"),
        patches.extract_patch("info.gameVersion").alias("patch"),
        F.col("info.gameDuration").alias("gameDuration"),
        F.coalesce(team, F.lit(0)).alias("winningTeamId"),
    )


def lane_pairs(slim: DataFrame) -> DataFrame:
    """Blue champion against the other side's per lane. The last participant of a lane and side counts."""
    blue = F.col("teamId") == 100
    pick = F.struct("pos", "championId", "championName", "win")
    lanes = (
        slim.where(F.col("position").isin(text.LANES))
        .groupBy("matchId", "position")
        .agg(
            F.max(F.when(blue, pick)).alias("b"),
            F.max(F.when(~blue, pick)).alias("r"),
        )
        .where(F.col("b").isNotNull() & F.col("r").isNotNull())
    )
    return lanes.select(
        "matchId",
        "position",
        F.col("b.championId").alias("champion1Id"),
        F.col("b.championName").alias("champion1Name"),
        F.col("r.championId").alias("champion2Id"),
        F.col("r.championName").alias("champion2Name"),
        F.when(F.col("b.win"), F.col("b.championId")).otherwise(F.col("r.championId")).alias("winnerId"),
        F.col("b.win").alias("firstWon"),
    )


def participant_map(timelines: DataFrame) -> DataFrame:
    """(matchId, participantId, puuid): place in the timeline's participant list plus one."""
    return timelines.select(
        F.col("metadata.matchId").alias("matchId"), F.posexplode("metadata.participants").alias("place", "puuid")
    ).select("matchId", (F.col("place") + 1).alias("participantId"), "puuid")


def unmatched_participants(ids: DataFrame, participants: DataFrame) -> DataFrame:
    """Timeline participants that the match document does not list."""
    return ids.join(participants.select("matchId", "puuid"), ["matchId", "puuid"], "left_anti").select(
        "matchId", "participantId", "puuid"
    )


def patch_list(versions: DataFrame) -> DataFrame:
    """Patch and full version in list order; the first one is current."""
    return versions.select(F.posexplode("versions").alias("place", "fullVersion")).select(
        "place",
        patches.extract_patch("fullVersion").alias("patch"),
        "fullVersion",
        (F.col("place") == 0).alias("current"),
    )
