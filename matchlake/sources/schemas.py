"""Explicit schemas (as DDL text) of the input documents and the stored tables. Nothing is ever inferred."""

from __future__ import annotations


def _schema(ddl: str) -> str:
    return " ".join(ddl.split())


_OBJECTIVE = "struct<first: boolean, kills: int>"

OBJECTIVES_SUMMARY = (
    f"struct<baron: {_OBJECTIVE}, champion: {_OBJECTIVE}, dragon: {_OBJECTIVE}, "
    f"inhibitor: {_OBJECTIVE}, riftHerald: {_OBJECTIVE}, tower: {_OBJECTIVE}>"
)

RUNES = (
    "struct<statPerks: struct<defense: int, flex: int, offense: int>, "
    "styles: array<struct<description: string, style: int, "
    "selections: array<struct<perk: int, var1: int, var2: int, var3: int>>>>>"
)

# Participants stay raw text here: they are exploded first and parsed one by one, so that
# properties with unknown names (the pings) can be picked up next to the declared ones.
MATCH = _schema(
    f"""
    metadata struct<matchId: string, participants: array<string>>,
    info struct<
        gameCreation: bigint, gameDuration: int, gameMode: string, gameVersion: string,
        mapId: int, queueId: int,
        participants: array<string>,
        teams: array<struct<
            teamId: int, win: boolean,
            bans: array<struct<championId: int, pickTurn: int>>,
            objectives: {OBJECTIVES_SUMMARY}>>>
    """
)

PARTICIPANT = _schema(
    f"""
    puuid string, summonerName string, championId int, championName string, teamId int,
    teamPosition string, individualPosition string, lane string, win boolean,
    kills int, deaths int, assists int, goldEarned int, totalDamageDealtToChampions int,
    totalDamageTaken int, visionScore int, totalMinionsKilled int, neutralMinionsKilled int,
    summoner1Id int, summoner2Id int, perks {RUNES}, challenges string
    """
)

_EVENT = """
    struct<type: string, timestamp: bigint, killerId: int, victimId: int, creatorId: int,
        participantId: int, itemId: int, beforeId: int, afterId: int, skillSlot: int,
        killerTeamId: int, teamId: int, wardType: string, monsterType: string,
        monsterSubType: string, buildingType: string, laneType: string, killType: string,
        position: struct<x: int, y: int>, assistingParticipantIds: array<int>>
"""

PARTICIPANT_FRAME = (
    "struct<participantId: int, position: struct<x: int, y: int>, totalGold: int, xp: int, minionsKilled: int, "
    "jungleMinionsKilled: int, damageStats: struct<totalDamageDoneToChampions: int>>"
)

TIMELINE = _schema(
    f"""
    metadata struct<matchId: string, participants: array<string>>,
    info struct<
        frameInterval: bigint,
        frames: array<struct<
            timestamp: bigint,
            participantFrames: map<string, {PARTICIPANT_FRAME}>,
            events: array<{_EVENT}>>>>
    """
)

CHAMPIONS_FILE = _schema(
    """
    type string, format string, version string,
    data map<string, struct<version: string, id: string, key: string, name: string, title: string>>
    """
)

LEAGUE_ENTRY = (
    "struct<puuid: string, queueType: string, tier: string, rank: string, leaguePoints: int, "
    "wins: int, losses: int>"
)
LEAGUE_LIST = _schema(f"tier string, leagueId string, queue string, name string, entries array<{LEAGUE_ENTRY}>")
RANKED_ENTRIES = _schema(f"puuid string, entries array<{LEAGUE_ENTRY}>")
MATCH_IDS = _schema("puuid string, ids array<string>")
VERSIONS = _schema("versions array<string>")

POSITIONS = "array<struct<x: int, y: int, timestamp: bigint>>"
WARDS = "array<struct<x: int, y: int, timestamp: bigint, wardType: string>>"
PATHING = "array<struct<x: int, y: int, time: bigint>>"
ITEMS = "array<struct<itemId: int, timestamp: bigint, type: string>>"
OBJECTIVES = "array<struct<type: string, subType: string, teamId: int, timestamp: bigint, killerId: int>>"

# Per-participant result of a parsed timeline: column name and type.
TIMELINE_COLUMNS = {
    "goldGraph": "array<int>",
    "xpGraph": "array<int>",
    "csGraph": "array<int>",
    "damageGraph": "array<int>",
    "deathPositions": POSITIONS,
    "killPositions": POSITIONS,
    "wardPositions": WARDS,
    "pathingSample": PATHING,
    "skillOrder": "array<string>",
    "itemTimeline": ITEMS,
    "soloKills15": "int",
    "soloDeaths15": "int",
}

MATCHES = _schema(
    "matchId string, gameCreation bigint, gameDuration int, gameMode string, queueId int, "
    f"gameVersion string, mapId int, hasTimeline boolean, patch string, objectives {OBJECTIVES}"
)
TEAMS = _schema(
    f"matchId string, patch string, teamId int, win boolean, bans array<int>, "
    f"objectives_summary {OBJECTIVES_SUMMARY}, objectives_timeline {OBJECTIVES}"
)
PARTICIPANTS = _schema(
    "matchId string, patch string, queueId int, gameVersion string, gameCreation bigint, gameDuration int, pos int, puuid string, summonerName string, championId int, championName string, "
    "teamId int, role string, lane string, win boolean, kills int, deaths int, assists int, kda double, "
    "goldEarned int, totalDamage int, damageTaken int, visionScore int, "
    f"runes {RUNES}, challenges string, pings map<string, int>, spells array<int>, "
    + ", ".join(f"{n} {t}" for n, t in TIMELINE_COLUMNS.items())
    + ", hasOpponent boolean, csd15 bigint, gd15 bigint, xpd15 bigint"
)
USERS = _schema(
    "puuid string, gameName string, tagLine string, region string, profileIconId int, summonerLevel int, "
    "summonerId string, tier string, rank string, leaguePoints int, rankedWins int, rankedLosses int, "
    "lastUpdated timestamp, createdAt timestamp"
)
