"""Every query by name, bound to the benchmark tables, with its output columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from matchlake.functions.numeric import rnd
from matchlake.functions.patches import previous_patch
from matchlake.operators import (
    activity,
    audit,
    catalog as catalogs,
    champion_stats as champions,
    collection,
    compare,
    details,
    gold,
    history,
    lanes,
    match_parser,
    player_stats as players,
    timeline_parser,
)
from matchlake.plans import reports
from matchlake.session import new_work_dir
from matchlake.sources import documents, schemas, star
from matchlake.sources.store import MatchStore
from matchlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COLUMNS: dict[str, list[tuple[str, str]]] = {}

# Parameters the parameterised queries are registered with.
PATCH = "13.2"
CHAMPION = 5
CHAMPION_NAME = "Blue Anvil 11"
FROM_MS, TO_MS = 852076800000, 978307200000
AUDIT_SECONDS, AUDIT_LIMIT = 900, 3
NOW_S = 4000


def columns_of(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in ddl.split(",")]


def query(ddl: str):
    """Registers a function under its own name; the result is cut to the declared plain columns."""

    def register(fn: Query) -> Query:
        name, cols = fn.__name__, columns_of(ddl)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[F.col(c).cast(t).alias(c) for c, t in cols])

        QUERIES[name], COLUMNS[name] = run, cols
        return run

    return register


def match_docs(spark, d):
    return documents.parse_json(star.match_documents(spark, d), schemas.MATCH)


def timeline_docs(spark, d):
    return documents.parse_json(star.timeline_documents(spark, d), schemas.TIMELINE)


def paired_docs(spark, d):
    return reports.paired(match_docs(spark, d), timeline_docs(spark, d), star.document_parts(spark, d))


def star_stats(spark, d):
    return champions.champion_stats_of(star.participants(spark, d), star.matches(spark, d), star.teams(spark, d))


def star_partials(spark, d, laning=False):
    return players.player_partials_of(star.participants(spark, d), star.matches(spark, d), laning, star.line_parts(spark, d))


def star_games(spark, d):
    return champions.game_rows(star.participants(spark, d), star.matches(spark, d))


def stored(spark, d):
    return star.matches(spark, d).where("status <> 'O'")


def joined(column):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string")))


# ---- match documents ---------------------------------------------------------------------------


@query("matchId string, gameCreation bigint, gameDuration bigint, gameMode string, queueId bigint, gameVersion string, mapId bigint, patch string")
def match_rows(spark, d):
    return match_parser.match_rows(match_docs(spark, d))


@query("matchId string, teamId bigint, win boolean, bans string, baronFirst boolean, towerKills bigint")
def team_rows(spark, d):
    return match_parser.team_rows(match_docs(spark, d)).withColumns(
        {
            "bans": joined("bans"),
            "baronFirst": F.col("objectives_summary.baron.first"),
            "towerKills": F.col("objectives_summary.tower.kills"),
        }
    )


@query("matchId string, championId bigint")
def match_bans(spark, d):
    return match_parser.match_bans(match_parser.team_rows(match_docs(spark, d)))


@query(
    "matchId string, pos bigint, puuid string, summonerName string, championId bigint, championName string, "
    "teamId bigint, role string, lane string, win boolean, kills bigint, deaths bigint, assists bigint, kda double, "
    "goldEarned bigint, totalDamage bigint, damageTaken bigint, visionScore bigint, offense bigint, kdaRatio double, "
    "pings string, spells string"
)
def participant_rows(spark, d):
    rows = match_parser.participant_rows(match_docs(spark, d))
    named = F.transform(F.array_sort(F.map_entries("pings")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.withColumns(
        {
            "offense": F.col("runes.statPerks.offense"),
            "kdaRatio": F.get_json_object("challenges", "$.kdaRatio"),
            "pings": F.concat_ws(",", named),
            "spells": joined("spells"),
        }
    )


@query(
    "matchId string, position string, puuid string, championId bigint, teamId bigint, win boolean, kills bigint, "
    "totalDamageDealtToChampions bigint, totalMinionsKilled bigint, neutralMinionsKilled bigint"
)
def slim_participants(spark, d):
    return match_parser.slim_participants(match_docs(spark, d))


@query("matchId string, patch string, gameDuration bigint, winningTeamId bigint")
def match_outcomes(spark, d):
    docs = match_docs(spark, d)
    return match_parser.match_outcomes(docs)


@query("matchId string, position string, champion1Id bigint, champion1Name string, champion2Id bigint, champion2Name string, winnerId bigint")
def lane_pairs(spark, d):
    return match_parser.lane_pairs(match_parser.slim_participants(match_docs(spark, d)))


@query("matchId string, participantId bigint, puuid string")
def participant_map(spark, d):
    return match_parser.participant_map(timeline_docs(spark, d))


@query("matchId string, participantId bigint, puuid string")
def unmatched_participants(spark, d):
    return match_parser.unmatched_participants(
        match_parser.participant_map(timeline_docs(spark, d)), match_parser.participant_rows(match_docs(spark, d))
    )


# ---- timeline documents ------------------------------------------------------------------------


@query("matchId string, puuid string, minute bigint, gold bigint, xp bigint, cs bigint, damage bigint")
def timeline_series(spark, d):
    parsed = timeline_parser.parse_timelines(timeline_docs(spark, d))
    zipped = F.arrays_zip("goldGraph", "xpGraph", "csGraph", "damageGraph")
    return parsed.select("matchId", "puuid", F.posexplode(zipped).alias("minute", "s")).select(
        "matchId", "puuid", "minute", F.col("s.goldGraph").alias("gold"), F.col("s.xpGraph").alias("xp"),
        F.col("s.csGraph").alias("cs"), F.col("s.damageGraph").alias("damage"),
    )


@query("matchId string, puuid string, place bigint, x bigint, y bigint, time bigint")
def timeline_paths(spark, d):
    parsed = timeline_parser.parse_timelines(timeline_docs(spark, d))
    return parsed.select("matchId", "puuid", F.posexplode("pathingSample").alias("place", "p")).select(
        "matchId", "puuid", "place", "p.*"
    )


@query("matchId string, puuid string, place bigint, itemId bigint, timestamp bigint, minute double, type string")
def timeline_items(spark, d):
    parsed = timeline_parser.parse_timelines(timeline_docs(spark, d))
    return details.item_events(parsed.withColumn("championId", F.lit(0)))


@query("matchId string, puuid string, skills string")
def skill_orders(spark, d):
    parsed = timeline_parser.parse_timelines(timeline_docs(spark, d))
    return parsed.withColumn("skills", F.concat_ws("", "skillOrder"))


@query("matchId string, puuid string, soloKills15 bigint, soloDeaths15 bigint")
def solo_fights(spark, d):
    return timeline_parser.parse_timelines(timeline_docs(spark, d))


@query("matchId string, place bigint, type string, subType string, teamId bigint, timestamp bigint, killerId bigint")
def timeline_objectives(spark, d):
    return timeline_parser.objectives(timeline_docs(spark, d))


@query("type string, isKill boolean, isWard boolean, isItem boolean, isElite boolean, isUsed boolean, events bigint")
def event_classes(spark, d):
    rows = timeline_parser.classified_events(timeline_docs(spark, d))
    return rows.groupBy("type", "isKill", "isWard", "isItem", "isElite", "isUsed").agg(F.count("*").alias("events"))


@query(
    "matchId string, puuid string, role string, minutes bigint, lastCs bigint, gold15 bigint, xp15 bigint, "
    "cs15 bigint, skills bigint, items bigint, finalBuild string"
)
def ingested_participants(spark, d):
    _, _, people = reports.ingested(paired_docs(spark, d))
    return reports.laning_snapshot(people).withColumn("finalBuild", joined("finalBuild"))


@query("matchId string, kind string, puuid string, championId bigint, x bigint, y bigint, timestamp bigint, minute bigint, type string, subType string, teamId bigint, killerId bigint")
def match_events(spark, d):
    docs, path = paired_docs(spark, d), new_work_dir(spark, "paired")
    # Histories and objectives are read from the same rows, whose timelines are parsed once.
    docs.write.parquet(path, compression="zstd")
    matches, _, people = reports.ingested(spark.read.schema(docs.schema).parquet(path))
    return details.match_events(people, matches)


@query("matchId string, puuid string, championId bigint, championName string, items bigint, finalBuild string")
def match_builds(spark, d):
    _, _, people = reports.ingested(paired_docs(spark, d))
    return details.match_builds(people).withColumns({"items": F.size("itemTimeline"), "finalBuild": joined("finalBuild")})


@query("matchId string, gameCreation string, patch string, teams bigint, participants bigint, teamContent string, content string")
def match_detail(spark, d):
    """Every match with all of its teams and participants, their content written out, one line each."""
    detail = documents.longs_as_text(details.match_detail(match_docs(spark, d)))
    text = lambda c: c.cast("string")

    def person(p):
        pings = F.transform(F.array_sort(F.map_entries(p["pings"])), lambda e: F.concat(e["key"], F.lit("="), text(e["value"])))
        plain = ["pos", "puuid", "summonerName", "championId", "championName", "teamId", "role", "lane", "win", "kills", "deaths", "assists"]
        more = ["goldEarned", "totalDamage", "damageTaken", "visionScore"]
        parts = [*[text(p[c]) for c in plain], text(F.round(p["kda"] * 1000).cast("long")), *[text(p[c]) for c in more], text(p["runes"]["statPerks"]["offense"])]
        return F.concat_ws("|", *parts, F.get_json_object(p["challenges"], "$.kdaRatio").cast("decimal(9,2)").cast("string"), F.concat_ws(",", pings), joined(p["spells"]))

    def team(t):
        goals = t["objectives_summary"]
        return F.concat_ws("|", text(t["teamId"]), text(t["win"]), joined(t["bans"]), text(goals["baron"]["first"]), text(goals["tower"]["kills"]))

    return detail.withColumns(
        {
            "teamContent": F.coalesce(F.array_join(F.transform("teams", team), "\n"), F.lit("")),
            "content": F.array_join(F.transform("participants", person), "\n"),
            "teams": F.coalesce(F.size("teams"), F.lit(0)),
            "participants": F.size("participants"),
        }
    )


# ---- catalog and patches -----------------------------------------------------------------------


@query("championId bigint, id string, name string, title string, normalName string, square string, loading string, splash string")
def champion_list(spark, d):
    return catalogs.champion_list(star.catalog(spark, d)).select("*", "images.*")


@query("place bigint, total bigint, championId bigint, id string, name string, title string, square string")
def champion_list_of_file(spark, d):
    catalog = documents.champions_from_file(documents.parse_json(star.catalog_file(spark, d), schemas.CHAMPIONS_FILE))
    return catalogs.sorted_champions(catalog).select("*", "images.*")


@query("puuid string, tier string, queueType string, rank string, leaguePoints bigint, wins bigint, losses bigint")
def league_entries(spark, d):
    return documents.explode_league(documents.parse_json(star.league_lists(spark, d), schemas.LEAGUE_LIST))


@query("puuid string, place bigint, matchId string")
def listed_match_ids(spark, d):
    """Id lists as they arrive, the 30 latest of each player as JSON, read and cut."""
    ids = collection.recent_match_ids(star.customer_games(spark, d), count=30)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("matchId").cast("string").alias("m")))), lambda x: x["m"])
    lists = ids.groupBy("puuid").agg(in_order.alias("ids"))
    text = lists.select(F.to_json(F.struct(F.col("puuid").cast("string").alias("puuid"), "ids")).alias("value"))
    return documents.take_match_ids(documents.parse_json(text, schemas.MATCH_IDS), count=5, start=2)


@query("place bigint, patch string, fullVersion string, current boolean")
def patch_list(spark, d):
    return match_parser.patch_list(star.versions(spark, d))


@query("patch string, previous string, previousPadded string")
def previous_patches(spark, d):
    return star.matches(spark, d).select("patch").distinct().select(
        "patch",
        previous_patch("patch").alias("previous"),
        previous_patch("patch", padded=True).alias("previousPadded"),
    )


# ---- ingest ------------------------------------------------------------------------------------


def landed_records(spark, d, root):
    """Match and timeline documents of each event block side by side, as they land: JSON files below root.

    They are written once, so that what reads them has a short plan, however many batches it is read in; and a reader of lines
    holds one record at a time, where one of column batches would hold thousands of timelines.
    """
    star.landed_records(spark, d).write.json(f"{root}/records", compression="gzip")
    return spark.read.schema(f"matchId string, {ingest.LANDED}").json(f"{root}/records")


def _landed_store(spark, d):
    """Runs the stream twice: half of the documents land first, then all of them again."""
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store", fanout=2).create()
    records = landed_records(spark, d, root)
    half = records.where(F.pmod(F.xxhash64("matchId"), F.lit(2)) == 0)
    for wave in (half, records):
        wave.select("match", "timeline").write.mode("append").json(f"{root}/landing", compression="gzip")
        ingest.run_available(spark, f"{root}/landing", store)
    return store


@query(
    "championId bigint, patch string, queueId bigint, gamesPlayed bigint, wins bigint, winRate double, kda double, "
    "dpm double, cspm double, banRate double, pickRate double"
)
def streaming_ingest(spark, d):
    return _landed_store(spark, d).champion_stats()


@query(
    "puuid string, championId bigint, patch string, queueId bigint, gamesPlayed bigint, wins bigint, avgKda double, "
    "avgCspm double, avgCsd15 double, avgGd15 double, avgXpd15 double, lastPlayedAt bigint"
)
def batch_ingest(spark, d):
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store").create()
    ingest.ingest(landed_records(spark, d, root), store, "batch", 0)
    return players.player_champion_stats(store.player_partials())


@query("matchId string, patch string, queueId bigint, gameCreation bigint")
def ingest_after_backfill(spark, d):
    """A batch of half of the documents first, then the stream over the others: both begin at number 0."""
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store").create()
    half = F.pmod(F.xxhash64("matchId"), F.lit(2)) == 0
    records = landed_records(spark, d, root)
    ingest.ingest(records.where(half), store, "backfill", 0)
    records.where(~half).select("match", "timeline").write.json(f"{root}/landing", compression="gzip")
    ingest.run_available(spark, f"{root}/landing", store)
    return store.table("matches")


@query("patch string, queueId bigint, matches bigint, participants bigint, created bigint")
def ingest_repeated(spark, d):
    """The same matches in and across batches, without a creation time and with another one; the first stay as they are."""
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store").create()
    records = landed_records(spark, d, root)
    untimed = records.withColumn("match", F.regexp_replace("match", '"gameCreation":[0-9]+,?', ""))
    later = records.withColumn("match", F.regexp_replace("match", '"gameCreation":[0-9]+', '"gameCreation":4102444800000'))
    for number, batch in enumerate((records.unionByName(untimed).unionByName(records), untimed, later.unionByName(untimed))):
        ingest.ingest(batch, store, "batch", number)
    people = store.table("participants").groupBy("matchId").agg(F.count("*").alias("n"))
    rows = store.table("matches").join(people, "matchId")
    return rows.groupBy("patch", "queueId").agg(F.count("*").alias("matches"), F.sum("n").alias("participants"), F.sum("gameCreation").alias("created"))


@query("wave bigint, came bigint, stored bigint")
def stream_repeats(spark, d):
    """Four landings with repeats: within the stream's memory, and two days later, when the store's ids find what it forgot.

    Of each landing: the records that came to the store's check, and those that it took.
    """
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store", fanout=2).create()
    kind = F.substring("matchId", 4, 20).cast("long") % 3
    records = landed_records(spark, d, root).withColumn("kind", kind)
    waves = {"2020-01-01 00:00:00": [0], "2020-01-01 00:10:00": [0, 1], "2020-01-03 00:00:00": [2], "2020-01-03 00:10:00": [0, 1, 2]}
    for at, kinds in waves.items():
        wave = records.where(F.col("kind").isin(kinds)).select("match", "timeline", F.lit(at).alias("landedAt"))
        wave.write.mode("append").json(f"{root}/landing", compression="gzip")
        ingest.run_available(
            spark, f"{root}/landing", store, remembered="1 hour", clock=F.col("landedAt"), landed=f"{ingest.LANDED}, landedAt timestamp"
        )
    batches = store.table("sources").where("came > 0")
    return batches.withColumn("wave", F.row_number().over(Window.partitionBy("source").orderBy("sourceBatch")))


@query("commit bigint, patch string, matches bigint, participants bigint")
def reads_across_commits(spark, d):
    """Matches and participants by patch as readers of each commit see them, all read at the end: the files of the earlier commits
    have been merged into larger ones by then, and stay readable."""
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store", fanout=2).create()
    records = landed_records(spark, d, root)
    kind, seen = F.substring("matchId", 4, 20).cast("long") % 4, []
    for number in range(4):
        ingest.ingest(records.where(kind == number), store, "batch", number)
        per_match = store.table("participants").groupBy("matchId", "patch").agg(F.count("*").alias("n"))
        per_patch = per_match.groupBy("patch").agg(F.count("*").alias("matches"), F.sum("n").alias("participants"))
        seen.append(per_patch.withColumn("commit", F.lit(number)))
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


@query("matchId string, reason string")
def rejected_records(spark, d):
    """Every third document broken, every third beside another match's timeline; what cannot be stored is kept with a reason."""
    root = new_work_dir(spark, "ingest")
    store = MatchStore(spark, f"{root}/store").create()
    kind = F.substring("matchId", 4, 20).cast("long") % 4
    records = landed_records(spark, d, root)
    records = records.withColumn("timeline", F.when(kind == 1, F.regexp_replace("timeline", '"matchId":"EV_', '"matchId":"EW_')).when(kind == 2, F.lit("{broken")).otherwise(F.col("timeline")))
    records = records.withColumn("match", F.when(kind == 3, F.lit("{")).otherwise(F.col("match")))
    ingest.ingest(records, store, "batch", 0)
    return store.table("rejected").unionByName(store.table("matches").select("matchId", F.lit("stored").alias("reason")), allowMissingColumns=True)


# ---- champions ---------------------------------------------------------------------------------


@query(
    "championId bigint, patch string, queueId bigint, gamesPlayed bigint, wins bigint, losses bigint, winRate double, "
    "kda double, dpm double, gpm double, cspm double, banRate double, pickRate double"
)
def champion_stats(spark, d):
    return star_stats(spark, d)


@query(
    "patch string, championId bigint, gamesPlayed bigint, totalKills bigint, totalDeaths bigint, totalAssists bigint, "
    "totalCs bigint, totalDamage bigint, totalGold bigint, totalDuration bigint, totalBans bigint"
)
def champion_totals(spark, d):
    return champions.champion_totals(star.participants(spark, d), star.matches(spark, d), star.teams(spark, d))


@query("championId bigint, patch string, primaryRole string, roleGames bigint")
def primary_roles(spark, d):
    return champions.primary_roles(star_games(spark, d))


@query("patch string, role string, championId1 bigint, championId2 bigint, gamesPlayed bigint, champion1Wins bigint, champion2Wins bigint, winRate1 double, winRate2 double")
def matchups(spark, d):
    slim = star.participants(spark, d).select(
        "matchId", "pos", F.col("role").alias("position"), "teamId", "championId",
        F.lit("").alias("championName"), "win",
    )
    return lanes.matchup_rates(lanes.matchups(match_parser.lane_pairs(slim), star.matches(spark, d)))


@query(
    "patch string, queueId bigint, championId bigint, championName string, square string, gamesPlayed bigint, wins bigint, "
    "losses bigint, winRate double, kda double, dpm double, cspm double, gpm double, banRate double, pickRate double, "
    "tier string, rank bigint, score double"
)
def tier_list(spark, d):
    rows = reports.tier_list(star_stats(spark, d), star.catalog(spark, d), queue_id=None, last_minor=star.LAST_MINOR)
    return rows.withColumns({"square": F.col("images.square"), "score": rnd("score", 4)})


@query("championId bigint, championName string, winRate double, pickRate double, tier string, rank bigint, total bigint")
def tier_list_page(spark, d):
    m = reports.patch_and_previous(star.matches(spark, d), PATCH, last_minor=star.LAST_MINOR)
    stats = champions.champion_stats_of(star.participants(spark, d), m, star.teams(spark, d))
    return reports.tier_list_page(
        stats, star.catalog(spark, d), PATCH, sort_by="pickRate", order="asc", page=2, limit=10,
        last_minor=star.LAST_MINOR,
    )


@query("patch string, championId bigint, championName string, gamesPlayed bigint, winRate double, tier string, rank bigint")
def champion_detail(spark, d):
    return reports.champion_detail(
        star_stats(spark, d), star.catalog(spark, d), CHAMPION_NAME, last_minor=star.LAST_MINOR
    )


@query("count bigint, patch string, message string")
def processed_matches(spark, d):
    m = star.matches(spark, d)
    asked = [(None, "exact"), (PATCH, "exact"), ("13", "prefix"), ("99.9", "exact")]
    parts = [reports.processed_matches(m, p, how) for p, how in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---- players -----------------------------------------------------------------------------------


@query(
    "puuid bigint, patch string, queueId bigint, gamesPlayed bigint, wins bigint, losses bigint, winRate double, "
    "avgKda double, avgDpm double, avgGpm double, avgCspm double, avgVisionScore double, lastPlayedAt bigint"
)
def player_stats(spark, d):
    return players.player_stats(star_partials(spark, d))


@query(
    "puuid bigint, championId bigint, patch string, queueId bigint, gamesPlayed bigint, wins bigint, losses bigint, "
    "winRate double, avgKda double, avgDpm double, avgGpm double, avgCspm double, avgVisionScore double, "
    "avgCsd15 double, avgGd15 double, avgXpd15 double, lastPlayedAt bigint"
)
def player_champion_stats(spark, d):
    return players.player_champion_stats(star_partials(spark, d, laning=True))


@query("puuid bigint, patch string, queueId bigint, role string, games bigint")
def role_distribution(spark, d):
    packed = players.role_distribution(star_partials(spark, d))
    return packed.select("puuid", "patch", "queueId", F.explode("roleDistribution").alias("role", "games"))


@query("puuid bigint, patch string, queueId bigint, place bigint, championId bigint, championName string, imageUrl string, games bigint, winRate double")
def top_champions(spark, d):
    return catalogs.enrich(players.top_champions(star_partials(spark, d)), star.catalog(spark, d))


@query(
    "puuid bigint, gamesPlayed bigint, wins bigint, losses bigint, winRate double, avgKda double, avgCspm double, "
    "avgDpm double, avgGpm double, avgVisionScore double, roles string, topChampions string"
)
def player_summary(spark, d):
    rows = reports.player_summary(star_partials(spark, d), star.catalog(spark, d))
    pair = F.transform(F.map_entries("roleDistribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    named = F.transform("topChampions", lambda c: F.concat(c["championName"], F.lit("="), c["games"].cast("string")))
    return rows.withColumns({"roles": F.concat_ws(",", pair), "topChampions": F.concat_ws(",", named)})


@query("puuid bigint, place bigint, championId bigint, championName string, gamesPlayed bigint, winRate double, avgKda double, avgCsd15 double")
def player_champions(spark, d):
    return reports.player_champions(
        star_partials(spark, d, laning=True), star.catalog(spark, d), role="MID", sort_by="winRate", limit=10
    )


_ROLE_COLUMNS = (
    "puuid bigint, place bigint, role string, gamesPlayed bigint, percentage double, wins bigint, losses bigint, winRate double, "
    "avgKda double, totalGames bigint"
)


@query(_ROLE_COLUMNS)
def player_roles(spark, d):
    return reports.player_roles(star.participants(spark, d), star.matches(spark, d))


@query(_ROLE_COLUMNS)
def player_roles_of_patch(spark, d):
    return reports.player_roles(star.participants(spark, d), star.matches(spark, d), patch=PATCH, match="prefix")


@query("puuid bigint, place bigint, dayOfWeek bigint, hour bigint, games bigint, wins bigint, losses bigint, winRate double")
def player_activity(spark, d):
    return activity.heatmap(reports.player_activity(star.participants(spark, d), star.matches(spark, d)))


@query(
    "puuid bigint, mostActiveDay string, mostActiveDayGames bigint, mostActiveHour bigint, mostActiveHourGames bigint, "
    "peakWinRate double, peakWinRateTime string, worstWinRate double, worstWinRateTime string"
)
def activity_insights(spark, d):
    return activity.activity_insights(reports.player_activity(star.participants(spark, d), star.matches(spark, d)))


@query("puuid bigint, dayOfWeek bigint, games bigint, wins bigint")
def activity_days(spark, d):
    return activity.day_totals(reports.player_activity(star.participants(spark, d), star.matches(spark, d)))


_HISTORY_COLUMNS = (
    "puuid bigint, place bigint, matchId bigint, championId bigint, championName string, role string, lane string, kills bigint, "
    "deaths bigint, assists bigint, kda double, goldEarned bigint, totalDamage bigint, visionScore bigint, cspm double, win boolean, "
    "gameCreation bigint, gameDuration bigint, queueId bigint, hasMore boolean, nextCursor bigint"
)


@query(_HISTORY_COLUMNS)
def player_matches(spark, d):
    rows = reports.player_games(star.participants(spark, d), star.matches(spark, d))
    return history.history_page(rows, page=2, limit=20)


@query(_HISTORY_COLUMNS)
def player_matches_filtered(spark, d):
    rows = reports.player_games(
        star.participants(spark, d), star.matches(spark, d),
        role="MID", result="win", start_ms=FROM_MS, end_ms=TO_MS,
    )
    return history.history_page(rows, limit=10, sort_by="kda")


def _sorted_history(spark, d, sort_by):
    rows = reports.player_games(star.participants(spark, d), star.matches(spark, d), champion_id=0)
    return history.history_page(rows, limit=15, sort_by=sort_by)


@query(_HISTORY_COLUMNS)
def player_matches_by_kills(spark, d):
    return _sorted_history(spark, d, "kills")


@query(_HISTORY_COLUMNS)
def player_matches_by_damage(spark, d):
    return _sorted_history(spark, d, "damage")


@query(_HISTORY_COLUMNS)
def player_matches_after(spark, d):
    rows = reports.player_games(star.participants(spark, d), star.matches(spark, d))
    fifth = history.history_page(rows, limit=5).where("place = 5")
    # Every tenth player asks with a cursor nobody knows and gets the top of the list.
    cursors = fifth.select("puuid", F.when(F.col("puuid") % 10 == 0, F.lit(-1)).otherwise(F.col("matchId")).alias("cursor"))
    return history.history_after(rows, cursors, limit=10)


@query("puuid bigint, matches bigint")
def history_counts(spark, d):
    games = star.participants(spark, d).join(star.matches(spark, d).select("matchId", "gameCreation", "queueId"), "matchId")
    return history.count_history(history.filter_history(games, champion_id=CHAMPION, result="loss"))


@query("puuid bigint, gameName string, tagLine string, region string, profileIconId bigint, summonerLevel bigint, tier string, rank string, leaguePoints bigint, rankedWins bigint, rankedLosses bigint, lastUpdated bigint, createdAt bigint")
def player_profile(spark, d):
    return reports.player_profile(star.users(spark, d))


@query(
    "puuid bigint, gameName string, region string, profileIconId bigint, summonerLevel bigint, summonerId string, "
    "tier string, leaguePoints bigint, rankedWins bigint, rankedLosses bigint, lastUpdated bigint, createdAt bigint"
)
def player_upsert(spark, d):
    return collection.upsert_players(star.profile_writes(spark, d))


# ---- matches -----------------------------------------------------------------------------------


@query("matchId bigint, minute bigint, blueTeam bigint, redTeam bigint, difference bigint")
def gold_timeline(spark, d):
    return gold.gold_timeline(star.participants(spark, d))


@query(
    "matchId bigint, winner string, maxAdvantageMinute bigint, maxAdvantageTeam string, maxAdvantage bigint, "
    "throwMinute bigint, throwBefore bigint, throwAfter bigint, throwSwing bigint"
)
def gold_insights(spark, d):
    return gold.gold_insights(gold.gold_timeline(star.participants(spark, d)), star.matches(spark, d))


@query("matchId bigint, type string, subType string, teamId bigint, timestamp bigint, minute bigint, killerId bigint")
def objective_events(spark, d):
    return details.objective_events(star.teams(spark, d))


@query(
    "matchId bigint, puuid bigint, pos bigint, championId bigint, role string, kda double, dpm double, gpm double, "
    "cspm double, visionScorePerMin double, damageTakenPerMin double, opponentPuuid bigint, opponentChampionId bigint, "
    "opponentKda double, opponentDpm double, opponentGpm double, opponentCspm double, dpmAdvantage double, "
    "dpmAdvantagePercent double, gpmAdvantage double, gpmAdvantagePercent double, cspmAdvantage double, "
    "cspmAdvantagePercent double, visionAdvantage double, survivability double"
)
def match_performance(spark, d):
    return details.match_performance(star.participants(spark, d), star.matches(spark, d))


# ---- comparison --------------------------------------------------------------------------------


def star_pairs(spark, d):
    """Each player against the neighbour by id."""
    p = F.col("puuid")
    return star.users(spark, d).select(p.alias("hero"), (p + 1 - 2 * (p % 2)).alias("villain"))


_COMPARE_COLUMNS = (
    "hero bigint, villain bigint, heroGameName string, villainGameName string, heroGamesPlayed bigint, "
    "villainGamesPlayed bigint, heroWinRate double, villainWinRate double, heroAvgKda double, villainAvgKda double, "
    "heroAvgCspm double, villainAvgCspm double, heroAvgDpm double, villainAvgDpm double, heroAvgVisionScore double, "
    "heroAvgCsd15 double, villainAvgCsd15 double, heroSoloKills15 bigint, villainSoloDeaths15 bigint, winner string, advantages string, "
    "recommendations string"
)


def _worded(rows):
    return rows.withColumns({c: F.array_join(c, " | ") for c in ("advantages", "recommendations")})


@query(_COMPARE_COLUMNS)
def compare_players(spark, d):
    return _worded(reports.compare_players(star_pairs(spark, d), star.users(spark, d), star_partials(spark, d)))


@query(_COMPARE_COLUMNS)
def compare_players_champion(spark, d):
    return _worded(
        reports.compare_players(
            star_pairs(spark, d), star.users(spark, d), star_partials(spark, d, laning=True), champion_id=CHAMPION
        )
    )


@query(_COMPARE_COLUMNS + ", heroCs string, villainCs string, heroGold string, villainGold string")
def comparison(spark, d):
    games = champions.with_match(
        players.with_laning(star.participants(spark, d).withColumns({"_cs": F.col("csGraph"), "_gold": F.col("goldGraph")})), star.matches(spark, d)
    ).withColumnsRenamed({"_cs": "csGraph", "_gold": "goldGraph"})
    rows = _worded(reports.comparison(star_pairs(spark, d), star.users(spark, d), games, champion_id=CHAMPION))
    return rows.withColumns({c: joined(F.col(c)) for c in ("heroCs", "villainCs", "heroGold", "villainGold")})


@query("hero bigint, villain bigint, side string, minute bigint, value bigint")
def compare_timelines(spark, d):
    return reports.compare_timelines(
        star_pairs(spark, d), star.participants(spark, d), star.matches(spark, d), "csGraph"
    )


@query("puuid bigint, minute bigint, value bigint")
def average_gold(spark, d):
    return compare.average_timeline(
        compare.timeline_games(reports.patch_games(star.participants(spark, d), star.matches(spark, d), "ALL", "exact", 420)),
        "goldGraph",
    )


# ---- collection --------------------------------------------------------------------------------


def _league(spark, d, tier):
    return star.leagues(spark, d).where(F.col("tier") == tier)


@query("puuid bigint")
def high_elo_players(spark, d):
    return collection.high_elo_players([_league(spark, d, t) for t in star.HIGH_LEAGUES])


@query("puuid bigint, place bigint, matchId bigint")
def recent_match_ids(spark, d):
    return collection.recent_match_ids(star.customer_games(spark, d), count=5, start=3, queue_id=420)


@query("puuid bigint, place bigint, matchId bigint")
def new_match_ids(spark, d):
    return collection.new_ids(collection.recent_match_ids(star.customer_games(spark, d)), stored(spark, d))


@query("puuid bigint, place bigint, matchId bigint")
def existing_match_ids(spark, d):
    return collection.existing_ids(collection.recent_match_ids(star.customer_games(spark, d)), stored(spark, d))


@query("playersFound bigint, matchesFound bigint, matchesEnqueued bigint, duplicatesSkipped bigint")
def collect_new_matches(spark, d):
    elo = collection.high_elo_players([_league(spark, d, t) for t in star.HIGH_LEAGUES])
    return collection.collection_counts(
        elo, collection.recent_match_ids(star.customer_games(spark, d)), stored(spark, d)
    )


@query("matchId bigint, priority bigint, place bigint")
def work_list(spark, d):
    return collection.in_order(collection.ranked_work(star.customer_games(spark, d), stored(spark, d)))


@query("puuid bigint, tier string, rank string, leaguePoints bigint, rankedWins bigint, rankedLosses bigint")
def ranked_entries(spark, d):
    return collection.ranked_solo(star.ranked_entries(spark, d))


def _customers(spark, d):
    return star.table(spark, d, "customer").select(F.col("c_custkey").alias("puuid"), F.col("c_name").alias("gameName"))


@query("puuid bigint, gameName string, tier string, leaguePoints bigint, matchesEnqueued bigint")
def search_players(spark, d):
    return collection.search_players(
        _customers(spark, d), star.ranked_entries(spark, d),
        collection.recent_match_ids(star.customer_games(spark, d)), stored(spark, d),
    )


@query("puuid bigint, status string, matchesEnqueued bigint, matchesTotal bigint, matchesAlreadyInDb bigint, message string")
def start_sync(spark, d):
    ids = collection.recent_match_ids(star.customer_games(spark, d), count=collection.SYNC_IDS, queue_id=420)
    return collection.start_sync(_customers(spark, d), ids, stored(spark, d))


@query("puuid bigint, status string, matchesProcessed bigint, matchesTotal bigint, startedAt bigint, message string")
def sync_status(spark, d):
    ids = collection.recent_match_ids(star.customer_games(spark, d), count=collection.SYNC_IDS, queue_id=420)
    asked = _customers(spark, d).select("puuid", (F.col("puuid") * 7 % NOW_S).alias("startedAt"))
    return collection.sync_status(asked, ids, stored(spark, d), NOW_S)


@query("puuid bigint, status string, matchesProcessed bigint, matchesTotal bigint, message string")
def update_status(spark, d):
    return collection.update_status(
        _customers(spark, d), collection.recent_match_ids(star.customer_games(spark, d)), stored(spark, d)
    )


@query("keyId string, ts_ms bigint, requestsInWindow bigint, maxRequests bigint, canProceed boolean")
def request_window(spark, d):
    return audit.request_window(star.requests(spark, d), AUDIT_SECONDS, AUDIT_LIMIT)
