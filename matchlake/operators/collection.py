"""Which matches to fetch next, for whom, and how far a fetch has come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlake.session import new_work_dir

# Queue name of the solo ladder, priorities of the work list, life of a sync request, id counts.
SOLO_QUEUE = "RANKED_SOLO_5x5"
PRIORITY_USER, PRIORITY_SYNC, PRIORITY_BACKGROUND = 10, 5, 1
SYNC_TTL_SECONDS = 1800
RECENT_IDS = 20
SYNC_IDS = 100
# Sentences of the status reports; {} stands for a number, or for stored/total.
TEXTS = {
    "no_matches": "No ranked matches found in Riot API",
    "all_stored": "All matches already in database",
    "sync_started": "Deep sync started: {} matches enqueued",
    "no_sync": "Nenhum sync em andamento",
    "sync_done": "Sync concluído: {} partidas processadas",
    "sync_running": "Sync em andamento: {} partidas processadas",
    "all_processed": "All matches processed",
    "processing": "Processing matches: {}",
}
# Fixed value: bits of a generated row number that count within its partition.
ROW_BITS = 33


def _say(key: str, *values: Column) -> Column:
    """A sentence with its number, or with two numbers and a stroke between them."""
    if not values:
        return F.lit(TEXTS[key])
    before, after = TEXTS[key].split("{}")
    return F.concat(F.lit(before), F.concat_ws("/", *[v.cast("string") for v in values]), F.lit(after))


def high_elo_players(leagues: list[DataFrame]) -> DataFrame:
    """Distinct players of all given leagues."""
    return reduce(DataFrame.unionByName, [entries.select("puuid") for entries in leagues]).distinct()


def recent_match_ids(
    played: DataFrame, count: int = RECENT_IDS, start: int = 0, queue_id: int | None = None
) -> DataFrame:
    """(puuid, place, matchId), newest first, places start .. start+count-1 of each player.

    `played` has puuid, matchId, gameCreation, queueId.
    """
    if queue_id is not None:
        played = played.where(F.col("queueId") == queue_id)
    # A player is in a match once; repeats of a pair would take up places.
    once = played.groupBy("puuid", "matchId").agg(F.max("gameCreation").alias("gameCreation"))
    w = Window.partitionBy("puuid").orderBy(F.desc("gameCreation"), F.desc("matchId"))
    # The bound is on the bare row number: only so is it pushed below the shuffle.
    ranked = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= start + count)
    return ranked.where(F.col("rank") > start).select("puuid", (F.col("rank") - 1).alias("place"), "matchId")


def new_ids(ids: DataFrame, stored: DataFrame) -> DataFrame:
    return ids.join(stored.select("matchId"), "matchId", "left_anti")


def existing_ids(ids: DataFrame, stored: DataFrame) -> DataFrame:
    return ids.join(stored.select("matchId"), "matchId", "left_semi")


def _counted(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """Per player: listed and stored ids."""
    known = stored.select("matchId", F.lit(1).alias("known"))
    return (
        ids.join(known, "matchId", "left")
        .groupBy("puuid")
        .agg(F.count("*").alias("total"), F.count("known").alias("stored"))
    )


def work_list(user: DataFrame, sync: DataFrame, background: DataFrame) -> DataFrame:
    """Pending match ids with their highest priority."""
    parts = [(user, PRIORITY_USER), (sync, PRIORITY_SYNC), (background, PRIORITY_BACKGROUND)]
    rows = reduce(DataFrame.unionByName, [d.select("matchId", F.lit(p).alias("priority")) for d, p in parts])
    return rows.groupBy("matchId").agg(F.max("priority").alias("priority"))


def ranked_work(
    played: DataFrame, stored: DataFrame, user: int = 3, sync: int = SYNC_IDS, background: int = RECENT_IDS, sync_queue: int = 420
) -> DataFrame:
    """(matchId, priority, gameCreation): pending ids of all players, from one ranking of `played` for all three kinds of
    request: a player's `user` latest games, the `sync` latest of the sync queue, the `background` latest.

    The bounded ranking within and without the sync queue goes first and is pushed below its shuffle, so of a player with very
    many games a few hundred move on.
    """
    once = played.groupBy("puuid", "matchId").agg(
        F.max("gameCreation").alias("gameCreation"), F.coalesce(F.max(F.col("queueId") == sync_queue), F.lit(False)).alias("synced")
    )
    newest = [F.desc("gameCreation"), F.desc("matchId")]
    within = once.withColumn("place", F.row_number().over(Window.partitionBy("puuid", "synced").orderBy(*newest)))
    some = within.where(F.col("place") <= max(user, sync, background))
    overall = F.row_number().over(Window.partitionBy("puuid").orderBy(*newest))
    priority = (
        F.when(F.col("overall") <= user, PRIORITY_USER)
        .when(F.col("synced") & (F.col("place") <= sync), PRIORITY_SYNC)
        .when(F.col("overall") <= background, PRIORITY_BACKGROUND)
    )
    asked = some.withColumn("overall", overall).withColumn("priority", priority).where("priority IS NOT NULL")
    best = asked.groupBy("matchId").agg(F.max("priority").alias("priority"), F.max("gameCreation").alias("gameCreation"))
    return best.join(stored.select("matchId"), "matchId", "left_anti")


def in_order(work: DataFrame) -> DataFrame:
    """The work list with `place`, from 0: highest priority first, then the newest game, then the id.

    Rows are sorted within ranges and numbered there; each range begins where those before it end. Nothing is sorted in one task:
    what is added up in one place is a row for each range. The numbered ranges are written once, so that both readings agree.
    """
    order = [F.desc("priority"), F.desc("gameCreation"), F.asc("matchId")]
    path = f"{new_work_dir(work.sparkSession, 'work-list')}/rows"
    # The id is the number of the range above the row's number within it.
    numbered = work.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    rows = work.sparkSession.read.schema(numbered.schema).parquet(path).withColumn("range", F.shiftright("number", ROW_BITS))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("range", before.alias("before")))  # a row for each range
    place = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.join(starts, "range").withColumn("place", place).drop("number", "range", "before")


def collection_counts(players: DataFrame, ids: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: players, ids found, new ids to fetch (each once), skipped."""
    found = ids.join(players, "puuid", "left_semi")
    known = stored.select("matchId", F.lit(True).alias("known"))
    per_match = found.groupBy("matchId").agg(F.count("*").alias("n")).join(known, "matchId", "left")
    rows = players.select(F.lit(1).alias("player"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("new")).unionByName(
        per_match.select(F.lit(0).alias("player"), "n", F.col("known").isNull().cast("int").alias("new"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        total("player").alias("playersFound"),
        total("n").alias("matchesFound"),
        total("new").alias("matchesEnqueued"),
    ).withColumn("duplicatesSkipped", F.col("matchesFound") - F.col("matchesEnqueued"))


def ranked_solo(entries: DataFrame) -> DataFrame:
    """First solo-queue entry of each player's entry list (puuid, entries); players without one stay, with nulls."""
    solo = F.get(F.filter("entries", lambda e: e["queueType"] == SOLO_QUEUE), F.lit(0))
    return entries.select("puuid", solo.alias("e")).select(
        "puuid",
        F.col("e.tier").alias("tier"),
        F.col("e.rank").alias("rank"),
        F.col("e.leaguePoints").alias("leaguePoints"),
        F.col("e.wins").alias("rankedWins"),
        F.col("e.losses").alias("rankedLosses"),
    )


def search_players(accounts: DataFrame, entries: DataFrame, ids: DataFrame, stored: DataFrame) -> DataFrame:
    """Account, ranked entry, and the number of new ids among the recent ones of each searched player."""
    counts = _counted(ids, stored)
    return (
        accounts.join(ranked_solo(entries), "puuid", "left")
        .join(counts, "puuid", "left")
        .withColumn("matchesEnqueued", F.coalesce(F.col("total") - F.col("stored"), F.lit(0)))
        .drop("total", "stored")
    )


def start_sync(players: DataFrame, ids: DataFrame, stored: DataFrame) -> DataFrame:
    """State right after a sync request over each player's latest ranked ids."""
    n = players.select("puuid").join(_counted(ids, stored), "puuid", "left").na.fill(0, ["total", "stored"])
    new = F.col("total") - F.col("stored")
    return n.select(
        "puuid",
        F.when((F.col("total") == 0) | (new == 0), F.lit("DONE")).otherwise(F.lit("SYNCING")).alias("status"),
        new.alias("matchesEnqueued"),
        F.col("total").alias("matchesTotal"),
        F.col("stored").alias("matchesAlreadyInDb"),
        F.when(F.col("total") == 0, _say("no_matches")).when(new == 0, _say("all_stored")).otherwise(_say("sync_started", new)).alias("message"),
    )


def sync_status(requests: DataFrame, tracked: DataFrame, stored: DataFrame, now_s) -> DataFrame:
    """Progress of sync requests (puuid, startedAt in epoch seconds); expired ones are idle.

    `tracked` lists the ids of each request.
    """
    n = requests.join(_counted(tracked, stored), "puuid", "left").na.fill(0, ["total", "stored"])
    alive = F.lit(now_s) - F.col("startedAt") < SYNC_TTL_SECONDS
    done = F.col("stored") >= F.col("total")
    progress = (F.col("stored"), F.col("total"))
    return n.select(
        "puuid",
        F.when(~alive, F.lit("IDLE")).when(done, F.lit("DONE")).otherwise(F.lit("SYNCING")).alias("status"),
        F.when(alive, F.col("stored")).otherwise(0).alias("matchesProcessed"),
        F.when(alive, F.col("total")).otherwise(0).alias("matchesTotal"),
        F.when(alive, F.col("startedAt")).alias("startedAt"),
        F.when(~alive, _say("no_sync")).when(done, _say("sync_done", *progress)).otherwise(_say("sync_running", *progress)).alias("message"),
    )


def update_status(players: DataFrame, ids: DataFrame, stored: DataFrame) -> DataFrame:
    """How many of each player's recent ids are stored."""
    n = players.select("puuid").join(_counted(ids, stored), "puuid", "left").na.fill(0, ["total", "stored"])
    idle = F.col("stored") == F.col("total")
    return n.select(
        "puuid",
        F.when(idle, F.lit("IDLE")).otherwise(F.lit("UPDATING")).alias("status"),
        F.col("stored").alias("matchesProcessed"),
        F.col("total").alias("matchesTotal"),
        F.when(idle, _say("all_processed")).otherwise(_say("processing", F.col("stored"), F.col("total"))).alias("message"),
    )


PROFILE = [
    "gameName", "tagLine", "profileIconId", "summonerLevel", "summonerId", "tier", "rank", "leaguePoints", "rankedWins",
    "rankedLosses",
]


def upsert_players(versions: DataFrame) -> DataFrame:
    """Latest profile of each player; region and creation time stay those of the first write.

    `versions` holds stored and new profiles with lastUpdated. One aggregation with map-side reduction.
    """
    return merge_players(versions.withColumn("createdAt", F.col("lastUpdated")))


def merge_players(versions: DataFrame) -> DataFrame:
    """As upsert_players, of profiles that have a createdAt: writes, their results, or both, in any split."""
    latest = F.struct("lastUpdated", *PROFILE)
    first = F.struct("createdAt", "region")
    return (
        versions.groupBy("puuid")
        .agg(F.max(latest).alias("l"), F.min(first).alias("f"))
        .select(
            "puuid",
            *[F.col(f"l.{c}").alias(c) for c in PROFILE],
            F.col("f.region").alias("region"),
            F.col("l.lastUpdated").alias("lastUpdated"),
            F.col("f.createdAt").alias("createdAt"),
        )
    )
