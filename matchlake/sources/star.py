"""Match-shaped views over the star-schema benchmark tables.

The tables hold no match documents, so matches, participants, teams and players are read out of orders,
lineitem, part, customer and supplier, and whole match and timeline documents out of events. The library
works on the result exactly as on parsed documents. Rows are mapped one to one; nothing is filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchlake.functions.numeric import kda
from matchlake.functions.patches import extract_patch
from matchlake.functions.text import LANES
from matchlake.functions.timeparts import epoch_ms

# Quarters stand in for minors, so a major ends with minor 4.
LAST_MINOR = 4
BLOCK = 60
FRAME_MS = 40000
#: Parts that documents are written in, at least.
DOCUMENT_PARTS = 48
#: Rows of a part: events, of which BLOCK become a match document and a timeline; lines.
EVENT_ROWS, LINE_ROWS = 2000 * BLOCK, 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(c: Column | str) -> Column:
    """Whole part of a non-negative number."""
    return F.floor(c).cast("int")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def matches(spark: SparkSession, sf_dir: str, player: bool = False) -> DataFrame:
    """A match per order; with its customer as the player if asked for."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    second = (key * 7919) % 86400
    version = F.concat_ws(".", (F.year(day) - 1985).cast("string"), F.quarter(day).cast("string"), F.lit("1"))
    return table(spark, sf_dir, "orders").select(
        key.alias("matchId"),
        (F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400000 + second * 1000 + 123).alias("gameCreation"),
        (900 + 60 * (key % 31)).cast("int").alias("gameDuration"),
        F.lit("CLASSIC").alias("gameMode"),
        F.when(F.col("o_orderpriority").startswith("5"), 440).otherwise(420).alias("queueId"),
        version.alias("gameVersion"),
        F.lit(11).alias("mapId"),
        F.lit(True).alias("hasTimeline"),
        extract_patch(version).alias("patch"),
        F.col("o_orderstatus").alias("status"),
        *([F.col("o_custkey").alias("puuid")] if player else []),
    )


def parts_of(df: DataFrame, rows: int) -> int:
    """Parts of about so many rows, and one for each core at least."""
    return max(min(df.sparkSession.sparkContext.defaultParallelism, 64), -(-df.count() // rows))


def gathered(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of a key side by side, moved while they are narrow: what is made of them is grouped and joined by key in its place.

    The number of parts follows the rows and is kept. By their bytes, which say nothing of what is made of them, parts would be
    merged, down to a single one.
    """
    return df.repartition(parts_of(df, rows), key)


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts that the participants of the lines are dealt into."""
    return parts_of(table(spark, sf_dir, "lineitem"), LINE_ROWS)


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line, qty, price = F.col("l_linenumber"), F.floor("l_quantity"), F.col("l_extendedprice")
    team = F.when(F.col("l_linestatus") == "O", 100).otherwise(200)
    roles = F.array(*[F.lit(r) for r in LANES])
    kills, deaths, assists = (qty % 15).cast("int"), (part % 11).cast("int"), (supp % 20).cast("int")
    rows = gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ROWS).select(
        order.alias("matchId"),
        (line.cast("long") * 1_000_000_000_000 + part).alias("pos"),
        supp.alias("puuid"),
        F.least(part % 50, _div(part, 50) % 50).cast("int").alias("championId"),
        team.alias("teamId"),
        F.get(roles, (line - 1) % 5).alias("role"),
        F.concat(F.get(roles, (line - 1) % 5), F.lit("_LANE")).alias("lane"),
        F.concat(F.lit("Champion "), F.least(part % 50, _div(part, 50) % 50).cast("string")).alias("championName"),
        ((team == 100) == (order % 2 == 0)).alias("win"),
        (part % 3).cast("int").alias("soloKills15"),
        (line % 2).cast("int").alias("soloDeaths15"),
        kills.alias("kills"),
        deaths.alias("deaths"),
        assists.alias("assists"),
        kda(kills, deaths, assists).alias("kda"),
        _int(price / 4).alias("goldEarned"),
        _int(price / 3).alias("totalDamage"),
        (_div(price, 5) + part % 1000).cast("int").alias("damageTaken"),
        (supp % 60 + line).cast("int").alias("visionScore"),
        (14 + order % 31 - F.when(line == 7, 1).otherwise(0)).cast("int").alias("_last"),
        (200 + part % 300).cast("int").alias("_gold"),
        (300 + supp % 200).cast("int").alias("_xp"),
        (4 + qty % 5).cast("int").alias("_cs"),
        (100 + part % 500).cast("int").alias("_damage"),
        (part % 3).cast("int").alias("_first"),
        (supp % 53).cast("int").alias("_s"),
    )
    last = F.col("_last")
    rising = lambda start, step: F.sequence(start, start + last * F.col(step), F.col(step))
    swings = F.transform(
        F.sequence(F.lit(0), last), lambda m: m * F.col("_gold") + F.col("_s") * m * m % 53 * 60 + 500
    )
    return rows.withColumns(
        {
            "goldGraph": swings,
            "xpGraph": rising(F.lit(0), "_xp"),
            "csGraph": rising(F.col("_first"), "_cs"),
            "damageGraph": rising(F.lit(0), "_damage"),
        }
    ).drop("_last", "_gold", "_xp", "_cs", "_damage", "_first", "_s")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two teams per match with bans and an objective list."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ids = {
        100: F.array(cust % 50, _div(key, 7) % 50, F.lit(-1).cast("long")),
        200: F.array((cust * 3 + 1) % 50, cust % 50),
    }

    def team(team_id: int) -> Column:
        goals = F.array(
            F.struct(
                F.lit("DRAGON").alias("type"),
                F.lit(None).cast("string").alias("subType"),
                F.lit(None).cast("int").alias("teamId"),
                (key % 31 * 30000 + team_id * 7).alias("timestamp"),
                (cust % 10 + 1).cast("int").alias("killerId"),
            ),
            F.struct(
                F.lit("TOWER").alias("type"),
                F.lit("MID_LANE").alias("subType"),
                F.lit(300 - team_id).alias("teamId"),
                (key % 31 * 60000 + team_id).alias("timestamp"),
                (key % 10 + 1).cast("int").alias("killerId"),
            ),
        )
        return F.struct(
            F.lit(team_id).alias("teamId"),
            (F.lit(team_id == 100) == (key % 2 == 0)).alias("win"),
            F.filter(F.transform(ids[team_id], lambda b: b.cast("int")), lambda b: b > 0).alias("bans"),
            goals.alias("objectives_timeline"),
        )

    return table(spark, sf_dir, "orders").select(key.alias("matchId"), F.inline(F.array(team(100), team(200))))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One champion per part size; champion 0 is played but not in the catalog."""
    size = F.col("p_size")
    return (
        table(spark, sf_dir, "part")
        .groupBy(size.cast("int").alias("championId"))
        .agg(F.min("p_name").alias("n"))
        .select(
            "championId",
            F.concat(F.lit("Champ"), F.col("championId").cast("string")).alias("id"),
            F.concat(F.initcap("n"), F.lit(" "), F.col("championId").cast("string")).alias("name"),
            F.concat(F.lit("the "), F.col("n")).alias("title"),
            F.lit("15.19.1").alias("version"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile per supplier."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    balance = F.col("s_acctbal")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").cast("long").alias("puuid"),
        F.col("s_name").alias("gameName"),
        F.lit("BR1").alias("tagLine"),
        F.col("n_name").alias("region"),
        (F.col("s_suppkey") % 29).alias("profileIconId"),
        (30 + F.col("s_suppkey") % 400).alias("summonerLevel"),
        F.when(balance > 0, F.when(balance > 5000, F.lit("GOLD")).otherwise(F.lit("SILVER"))).alias("tier"),
        F.floor(F.abs(balance) / 100).cast("int").alias("leaguePoints"),
        F.when(balance > 0, F.get(F.array(*map(F.lit, ("I", "II", "III", "IV"))), (F.col("s_suppkey") % 4).cast("int"))).alias("rank"),
        (F.col("s_suppkey") % 100).cast("int").alias("rankedWins"),
        (F.col("s_suppkey") % 90).cast("int").alias("rankedLosses"),
        F.timestamp_seconds(1_700_000_000 + F.col("s_suppkey")).alias("lastUpdated"),
        F.timestamp_seconds(1_600_000_000 + F.col("s_suppkey")).alias("createdAt"),
    )


def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as the one JSON object that its file holds. A catalog has some fifty champions."""
    entry = F.struct(F.col("championId").cast("string").alias("key"), "id", "name", "title", "version")
    packed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", entry.alias("c")))))
    return catalog(spark, sf_dir).agg(packed.alias("data")).select(F.to_json(F.struct("data")).alias("value"))


def league_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League lists as JSON, of at most 50 entries each; every other entry leaves its tier to the list."""
    key = F.col("c_custkey")
    entry = F.struct(
        key.cast("string").alias("puuid"),
        F.lit("RANKED_SOLO_5x5").alias("queueType"),
        F.when(key % 2 == 0, F.concat(F.col("c_mktsegment"), F.lit(" OWN"))).alias("tier"),
        F.lit("I").alias("rank"),
        _int(F.abs("c_acctbal") / 10).alias("leaguePoints"),
        (key % 70).cast("int").alias("wins"),
        (key % 60).cast("int").alias("losses"),
    )
    lists = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("tier"), _div(key, 50).alias("block"))
    return lists.agg(F.collect_list(entry).alias("entries")).select(F.to_json(F.struct("tier", "entries")).alias("value"))


def profile_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a write of its customer's profile."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("puuid"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1_000_000 + key % 1_000_000).alias("lastUpdated"),
        F.concat(F.lit("Name"), (key % 7).cast("string")).alias("gameName"),
        F.lit("BR1").alias("tagLine"),
        F.col("o_orderpriority").alias("region"),
        (key % 29).alias("profileIconId"),
        (30 + key % 400).alias("summonerLevel"),
        F.concat(F.lit("S"), key.cast("string")).alias("summonerId"),
        F.col("o_orderstatus").alias("tier"),
        F.lit("I").alias("rank"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("leaguePoints"),
        (key % 100).alias("rankedWins"),
        (key % 90).alias("rankedLosses"),
    )


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League lists: customers of a market segment are one list, the segment its tier."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("puuid"),
        F.col("c_mktsegment").alias("tier"),
        F.floor(F.abs("c_acctbal") / 10).cast("int").alias("leaguePoints"),
    )


HIGH_LEAGUES = ["AUTOMOBILE", "BUILDING", "MACHINERY"]


def ranked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry list of each customer: flex always, solo when the balance is positive, a second solo as a decoy."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")

    def entry(queue: str, tier: Column, points: Column) -> Column:
        return F.struct(
            F.lit(queue).alias("queueType"),
            tier.alias("tier"),
            F.lit("II").alias("rank"),
            points.cast("int").alias("leaguePoints"),
            (key % 100).cast("int").alias("wins"),
            (key % 90).cast("int").alias("losses"),
        )

    flex = entry("RANKED_FLEX_SR", F.lit("IRON"), F.lit(1))
    solo = entry("RANKED_SOLO_5x5", F.col("c_mktsegment"), F.floor(F.abs(balance) / 100))
    decoy = entry("RANKED_SOLO_5x5", F.lit("DECOY"), F.lit(2))
    return table(spark, sf_dir, "customer").select(
        key.alias("puuid"), F.when(balance > 0, F.array(flex, solo, decoy)).otherwise(F.array(flex)).alias("entries")
    )


def customer_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(puuid, matchId, gameCreation, queueId, status) with the ordering customer as player."""
    return matches(spark, sf_dir, player=True).select("puuid", "matchId", "gameCreation", "queueId", "status")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), epoch_ms("ts").alias("ts_ms"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the distinct versions of all matches, newest first. Bounded by the quarters of the date range."""
    day = F.col("o_orderdate").cast("date")
    distinct = table(spark, sf_dir, "orders").groupBy(F.year(day).alias("y"), F.quarter(day).alias("q")).count()
    newest = F.sort_array(F.collect_list(F.struct("y", "q")), asc=False)
    return distinct.agg(newest.alias("v")).select(
        F.transform(
            "v", lambda v: F.concat_ws(".", (v["y"] - 1985).cast("string"), v["q"].cast("string"), F.lit("1"))
        ).alias("versions")
    )


# ---- documents ---------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their block. A block is 60 consecutive event ids, whatever the size of the table."""
    return table(spark, sf_dir, "events").select(
        _div(F.col("event_id"), BLOCK).alias("block"),
        (F.col("event_id") % BLOCK).cast("int").alias("i"),
        F.col("user_id").cast("int").alias("u"),
        F.col("event_type").alias("kind"),
        _int(F.col("value")).alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        epoch_ms("ts").alias("ts_ms"),
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(_events(spark, sf_dir), "block", EVENT_ROWS)


def document_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts that the documents of the events are made in."""
    return parts_of(table(spark, sf_dir, "events"), EVENT_ROWS)


def _match_id() -> Column:
    return F.concat(F.lit("EV_"), F.col("block").cast("string"))


def _player(block: Column, n: Column) -> Column:
    return F.concat(F.lit("P"), ((block * 3 + n * 7) % 97).cast("string"))


def _match_sums() -> list[Column]:
    return [F.sum("k").alias("k"), F.sum("v").alias("v"), F.min("ts_ms").alias("t")]


def _match_text() -> Column:
    """The match document of a block with its sums."""
    block, k, v = F.col("block"), F.col("k"), F.col("v")
    roles = F.array(*[F.lit(r) for r in LANES])

    def person(n: Column) -> Column:
        role = F.get(roles, (n - 1) % 5)
        champion = 1 + (block + n * n) % 50
        team = F.when(n <= 5, 100).otherwise(200)
        return F.struct(
            _player(block, n).alias("puuid"),
            F.concat(F.lit("Summoner "), n.cast("string")).alias("summonerName"),
            champion.alias("championId"),
            F.concat(F.lit("Champion "), champion.cast("string")).alias("championName"),
            team.alias("teamId"),
            F.when((block + n) % 11 == 0, F.lit("")).otherwise(role).alias("teamPosition"),
            F.when((block + n) % 22 == 0, F.lit("")).otherwise(role).alias("individualPosition"),
            F.when(n == 3, F.lit("")).otherwise(F.concat(role, F.lit("_LANE"))).alias("lane"),
            ((team == 100) == (k % 2 == 0)).alias("win"),
            ((k + n) % 15).alias("kills"),
            ((k * n) % 9).alias("deaths"),
            ((v + n) % 20).alias("assists"),
            (8000 + v * n % 7000).alias("goldEarned"),
            (5000 + v * n * 3 % 30000).alias("totalDamageDealtToChampions"),
            (4000 + k * n % 20000).alias("totalDamageTaken"),
            F.when(n != 10, (k + n * 5) % 80).alias("visionScore"),
            (n * 20 + k % 7).alias("totalMinionsKilled"),
            (n + v % 5).alias("neutralMinionsKilled"),
            F.lit(4).alias("summoner1Id"),
            (11 + n % 4).alias("summoner2Id"),
            F.struct(
                F.struct((5000 + n).alias("defense"), (5001 + n).alias("flex"), (5002 + n).alias("offense")).alias("statPerks"),
                F.array(F.struct(F.lit("primaryStyle").alias("description"), (8000 + n).alias("style"))).alias("styles"),
            ).alias("perks"),
            F.struct((k % 10 / 4).alias("kdaRatio"), (n == 1).alias("firstBlood"), F.array(n, n + 1).alias("steps")).alias("challenges"),
            n.alias("allInPings"),
            ((k + n) % 9).alias("onMyWayPings"),
            (v % 6).alias("commandPings"),
            F.array(F.lit(1)).alias("pings"),
        )

    def goal(x: Column) -> Column:
        return F.struct((x % 2 == 0).alias("first"), (x % 4).alias("kills"))

    def team(team_id: int) -> Column:
        bans = F.array(
            F.struct(((block * 7 + team_id) % 50).alias("championId"), F.lit(1).alias("pickTurn")),
            F.struct(F.lit(-1).cast("long").alias("championId"), F.lit(2).alias("pickTurn")),
            F.struct((k % 50).alias("championId"), F.lit(3).alias("pickTurn")),
        )
        return F.struct(
            F.lit(team_id).alias("teamId"),
            (F.lit(team_id == 100) == (k % 2 == 0)).alias("win"),
            F.when((block % 6 != 0) | F.lit(team_id == 100), bans).alias("bans"),
            F.struct(
                *[
                    goal(k + i * team_id).alias(n)
                    for i, n in enumerate(["baron", "champion", "dragon", "inhibitor", "riftHerald", "tower"])
                ]
            ).alias("objectives"),
        )

    tens = F.sequence(F.lit(1), F.lit(10))
    doc = F.struct(
        F.struct(
            _match_id().alias("matchId"), F.transform(tens, lambda n: _player(block, n)).alias("participants")
        ).alias("metadata"),
        F.struct(
            F.col("t").alias("gameCreation"),
            (1500 + k % 1200).alias("gameDuration"),
            F.lit("CLASSIC").alias("gameMode"),
            F.concat(F.lit("15."), (1 + block % 12).cast("string"), F.lit(".712.1836")).alias("gameVersion"),
            F.lit(11).alias("mapId"),
            F.when(block % 5 == 0, 440).otherwise(420).alias("queueId"),
            F.transform(tens, person).alias("participants"),
            F.when(block % 13 != 0, F.array(team(100), team(200))).alias("teams"),
        ).alias("info"),
    )
    return F.to_json(doc)


def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per block of events (column `value`), in the shape of a match document."""
    return _blocks(spark, sf_dir).groupBy("block").agg(*_match_sums()).select(_match_text().alias("value"))


def _timeline_rows() -> Column:
    return F.sort_array(F.collect_list(F.struct("i", "u", "kind", "v", "k"))).alias("rows")


def _timeline_text() -> Column:
    """The timeline of a block with its events: every event is a frame with one event."""
    block = F.col("block")
    tens = F.sequence(F.lit(1), F.lit(10))

    def stats(e: Column, n: Column) -> Column:
        return F.struct(
            n.alias("participantId"),
            F.when(e["u"] % 6 != 0, F.struct((e["v"] * n % 15000).alias("x"), (n * 100 + e["i"]).alias("y"))).alias("position"),
            (500 + e["i"] * 90 + e["v"] % 50 * n).alias("totalGold"),
            (e["i"] * 110 + e["u"] % 20 * n).alias("xp"),
            (e["i"] + n).alias("minionsKilled"),
            (e["u"] % 5).alias("jungleMinionsKilled"),
            F.struct(((e["v"] + e["i"] * 20) * n).alias("totalDamageDoneToChampions")).alias("damageStats"),
        )

    def people(e: Column) -> Column:
        present = F.filter(tens, lambda n: (n + e["u"]) % 4 != 0)
        return F.map_from_entries(F.transform(present, lambda n: F.struct(n.cast("string"), stats(e, n))))

    def event(e: Column) -> Column:
        kind, u, k = e["kind"], e["u"], e["k"]
        type_ = (
            F.when(kind == "click", F.lit("CHAMPION_KILL"))
            .when(kind == "view", F.lit("WARD_PLACED"))
            .when(kind == "purchase", F.lit("ITEM_PURCHASED"))
            .when((kind == "signup") & (k % 2 == 0), F.lit("SKILL_LEVEL_UP"))
            .when(kind == "signup", F.lit("ITEM_UNDO"))
            .when(k % 5 == 0, F.lit("ITEM_SOLD"))
            .when(k % 5 == 1, F.lit("ELITE_MONSTER_KILL"))
            .when(k % 5 == 2, F.lit("BUILDING_KILL"))
            .when(k % 5 == 3, F.lit("WARD_KILL"))
            .otherwise(F.lit("CHAMPION_SPECIAL_KILL"))
        )
        return F.struct(
            type_.alias("type"),
            (e["i"].cast("long") * FRAME_MS + 500).alias("timestamp"),
            (u % 11).alias("killerId"),
            F.when(kind == "click", k % 10 + 1).alias("victimId"),
            F.when(kind == "view", u % 11).alias("creatorId"),
            F.when(type_ == "SKILL_LEVEL_UP", u % 10 + 1).otherwise(u % 3 + 1).alias("participantId"),
            (1000 + k % 4).alias("itemId"),
            (1000 + k % 4).alias("beforeId"),
            (k % 5 + 1).alias("skillSlot"),
            F.when(k % 2 == 0, 100).otherwise(200).alias("killerTeamId"),
            F.when(k % 3 == 0, 100).otherwise(200).alias("teamId"),
            F.when(k % 2 == 0, F.lit("YELLOW_TRINKET")).otherwise(F.lit("CONTROL_WARD")).alias("wardType"),
            F.when(k % 2 == 0, F.lit("DRAGON")).otherwise(F.lit("HORDE")).alias("monsterType"),
            F.when(k % 3 == 0, F.lit("FIRE")).otherwise(F.lit("")).alias("monsterSubType"),
            F.when(k % 4 == 0, F.lit("INHIBITOR_BUILDING")).otherwise(F.lit("TOWER_BUILDING")).alias("buildingType"),
            F.when(k % 2 == 0, F.lit("TOP_LANE")).otherwise(F.lit("MID_LANE")).alias("laneType"),
            F.when(u % 2 == 0, F.lit("KILL_SOLO")).otherwise(F.lit("KILL_FIRST_BLOOD")).alias("killType"),
            F.struct(e["v"].alias("x"), e["i"].alias("y")).alias("position"),
            F.when(k % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("assistingParticipantIds"),
        )

    ids = F.transform(tens, lambda n: F.when((n == 2) & (block % 9 == 0), F.concat(F.lit("X"), block.cast("string"))).otherwise(_player(block, n)))
    listed = F.when(block % 7 == 0, F.slice(ids, 1, 9)).otherwise(ids)
    frames = F.transform(
        "rows",
        lambda e: F.struct(
            (e["i"].cast("long") * FRAME_MS).alias("timestamp"),
            people(e).alias("participantFrames"),
            F.array(event(e)).alias("events"),
        ),
    )
    doc = F.struct(
        F.struct(_match_id().alias("matchId"), listed.alias("participants")).alias("metadata"),
        F.struct(F.lit(FRAME_MS).alias("frameInterval"), frames.alias("frames")).alias("info"),
    )
    return F.to_json(doc)


def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per block of events (column `value`), in the shape of a timeline."""
    return _blocks(spark, sf_dir).groupBy("block").agg(_timeline_rows()).select(_timeline_text().alias("value"))


def landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(matchId, match, timeline): both documents of each block of events, written from one grouping of its events."""
    # A block's documents are some fifty times its events, so the parts follow the documents and are not merged by size.
    events = _events(spark, sf_dir).where("block IS NOT NULL")
    events = events.repartition(max(DOCUMENT_PARTS, parts_of(events, EVENT_ROWS)), "block")
    grouped = events.groupBy("block").agg(*_match_sums(), _timeline_rows())
    return grouped.select(_match_id().alias("matchId"), _match_text().alias("match"), _timeline_text().alias("timeline"))
