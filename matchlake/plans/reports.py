"""The user-facing reports. Each composes operators; a request for one id is a `where` on the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from matchlake.functions.nested import bound
from matchlake.functions.numeric import at_or_zero, last_or_zero
from matchlake.functions.patches import ALL_PATCHES, extract_patch, filter_patch, previous_patch
from matchlake.functions.text import normalise_name, role_alias
from matchlake.operators import (
    activity,
    catalog as catalogs,
    champion_stats as champions,
    compare,
    details,
    history,
    lanes,
    match_parser,
    player_stats as players,
    tiers,
    timeline_parser,
)
from matchlake.sources import schemas

RANKED = 420
MOST_CHAMPIONS = 50
# Fixed value: what is said of a patch without matches.
NO_DATA = "Não há dados para o patch {}"


def patch_and_previous(matches: DataFrame, patch: str, padded: bool = False, last_minor: int = 23) -> DataFrame:
    """Matches of a patch and the one before, all that its tier list reads."""
    wanted = F.array(F.lit(patch), previous_patch(F.lit(patch), padded, last_minor))
    return matches.where(F.array_contains(wanted, F.col("patch")))


def tier_list(
    stats: DataFrame, catalog: DataFrame, patch: str | None = None, queue_id: int | None = RANKED, last_minor: int = 23
) -> DataFrame:
    """Scored, ranked and enriched champions of one patch, or of every patch side by side."""
    rows = stats if queue_id is None else stats.where(F.col("queueId") == queue_id)
    scored = filter_patch(tiers.with_scores(rows, last_minor=last_minor), patch)
    return tiers.rounded(tiers.with_ranks(tiers.known_champions(scored, catalog)))


def tier_list_page(
    stats: DataFrame,
    catalog: DataFrame,
    patch: str,
    queue_id: int = RANKED,
    sort_by: str = "winRate",
    order: str = "desc",
    page: int = 1,
    limit: int = 20,
    last_minor: int = 23,
) -> DataFrame:
    rows = tier_list(stats, catalog, patch, queue_id, last_minor)
    total = F.count("*").over(Window.partitionBy("patch", "queueId"))
    return tiers.sort_page(rows.withColumn("total", total), sort_by, order, page, limit)


def champion_detail(
    stats: DataFrame,
    catalog: DataFrame,
    name: str,
    patch: str | None = None,
    queue_id: int | None = RANKED,
    last_minor: int = 23,
) -> DataFrame:
    """A champion by name. Its rank counts every champion with enough games, known to the catalog or not."""
    rows = stats if queue_id is None else stats.where(F.col("queueId") == queue_id)
    ranked = tiers.with_ranks(filter_patch(tiers.with_scores(rows, last_minor=last_minor), patch))
    one = catalog.where(normalise_name("name") == normalise_name(F.lit(name)))
    return tiers.rounded(tiers.known_champions(ranked, one))


def processed_matches(matches: DataFrame, patch: str | None = None, match: str = "exact") -> DataFrame:
    """One row: the number of stored matches, with a message when a patch has none."""
    n = filter_patch(matches, patch, match).agg(F.count("*").alias("count"))
    none = F.lit(NO_DATA.format(patch)) if patch else F.lit(None)
    return n.select(
        "count", F.lit(patch).cast("string").alias("patch"), F.when(F.col("count") == 0, none).cast("string").alias("message")
    )


def player_summary(
    partials: DataFrame, catalog: DataFrame, patch: str = ALL_PATCHES, queue_id: int = RANKED
) -> DataFrame:
    """Rates, games per role and the top champions of each player."""
    named = lambda rows: catalogs.enrich(rows, catalog).drop("imageUrl")
    return players.summaries(partials.where(F.col("queueId") == queue_id), patch, named)


def player_champions(
    partials: DataFrame,
    catalog: DataFrame,
    patch: str = ALL_PATCHES,
    queue_id: int = RANKED,
    role: str | None = None,
    sort_by: str = "games",
    limit: int = 10,
) -> DataFrame:
    """The best champions of each player in the given order, optionally those played in a role."""
    if not 1 <= limit <= MOST_CHAMPIONS:
        raise ValueError(f"limit is 1 to {MOST_CHAMPIONS}")
    stats = players.player_champion_stats(partials.where(F.col("queueId") == queue_id), patch, roles=role is not None)
    if role is not None:
        stats = stats.where(F.coalesce(F.try_element_at("roleDistribution", F.lit(role_alias(role))), F.lit(0)) > 0)
    column = {"winRate": "winRate", "kda": "avgKda"}.get(sort_by, "gamesPlayed")
    w = Window.partitionBy("puuid").orderBy(F.desc(column), "championId")
    best = stats.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return catalogs.enrich(best, catalog)


def player_roles(
    participants: DataFrame, matches: DataFrame, patch: str = ALL_PATCHES, match: str = "exact", queue_id: int = RANKED
) -> DataFrame:
    return players.role_report(patch_games(participants, matches, patch, match, queue_id))


def patch_games(participants, matches, patch, match, queue_id) -> DataFrame:
    """Games of a patch and queue. The conditions reach the side that holds the columns."""
    games = champions.with_match(participants, matches, ["patch", "queueId", "gameVersion", "gameCreation"])
    return filter_patch(games, patch, match).where(F.col("queueId") == queue_id)


def player_activity(
    participants: DataFrame, matches: DataFrame, patch: str = ALL_PATCHES, match: str = "exact", queue_id: int = RANKED
) -> DataFrame:
    """Observed activity cells; feed them to activity.heatmap and activity.activity_insights."""
    return activity.activity_cells(patch_games(participants, matches, patch, match, queue_id))


def player_games(participants: DataFrame, matches: DataFrame, **filters) -> DataFrame:
    """Filtered history rows."""
    games = champions.with_match(
        champions.with_last_cs(participants), matches, ["gameCreation", "gameDuration", "queueId"]
    )
    return history.history_rows(history.filter_history(games, **filters))


def player_profile(users: DataFrame) -> DataFrame:
    names = [
        "puuid", "gameName", "tagLine", "region", "profileIconId", "summonerLevel", "tier", "rank", "leaguePoints",
        "rankedWins", "rankedLosses", "lastUpdated", "createdAt",
    ]
    missing = [c for c in names if c not in users.columns]
    if missing:
        raise ValueError(f"profiles without {', '.join(missing)}")
    return users.select(*names)


def compare_players(
    pairs: DataFrame,
    users: DataFrame,
    partials: DataFrame,
    patch: str = ALL_PATCHES,
    champion_id: int | None = None,
    queue_id: int = RANKED,
) -> DataFrame:
    """Stats, laning and insights of each (hero, villain) pair."""
    played = partials.where(F.col("queueId") == queue_id)
    if champion_id is not None:
        stats = players.player_champion_stats(played.where(F.col("championId") == champion_id), patch or ALL_PATCHES)
    else:
        stats = players.player_stats(played, patch or ALL_PATCHES).withColumns({n: F.lit(0.0) for n in compare.LANING})
    return compare.with_insights(compare.compare_stats(pairs, users, stats, laning=champion_id is not None))


def comparison(
    pairs: DataFrame,
    users: DataFrame,
    games: DataFrame,
    patch: str = ALL_PATCHES,
    champion_id: int | None = None,
    queue_id: int = RANKED,
) -> DataFrame:
    """Stats, laning, solo fights, insights and both averaged series of each pair, from one pass over the games.

    `games` are rows of champion_stats.with_match over participants with laning columns and series.
    """
    played = filter_patch(champions.with_rates(games), patch).where(F.col("queueId") == queue_id)
    if champion_id is not None:
        played = played.where(F.col("championId") == champion_id)
    stats = compare.stats_and_series(played, {"csGraph": "cs", "goldGraph": "gold"})
    return compare.with_insights(compare.compare_stats(pairs, users, stats, laning=champion_id is not None))


def compare_timelines(
    pairs: DataFrame,
    participants: DataFrame,
    matches: DataFrame,
    column: str,
    patch: str = ALL_PATCHES,
    role: str | None = None,
    champion_id: int | None = None,
    queue_id: int = RANKED,
) -> DataFrame:
    games = patch_games(participants, matches, patch, "exact", queue_id)
    if role is not None:
        games = games.where(F.col("role") == role_alias(role))
    if champion_id is not None:
        games = games.where(F.col("championId") == champion_id)
    return compare.compare_timelines(pairs, compare.average_timeline(compare.timeline_games(games), column))


def paired(match_docs: DataFrame, timeline_docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Match documents with the results of their timelines. A match without a timeline is left out.

    Timelines are reduced to their results inside their rows first, so the one join moves those and no frames. With parts both
    sides are dealt by match into so many: the texts of a document are larger than Spark takes them to be, so left to itself
    it may broadcast all of them or meet too many in one task.
    """
    docs, results = match_docs.withColumn("matchId", F.col("metadata.matchId")), timeline_parser.timeline_results(timeline_docs)
    if parts:
        docs, results = docs.repartition(parts, "matchId"), results.repartition(parts, "matchId")
    return docs.join(results, "matchId")


def ingested(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, teams, participants) of paired documents. Nothing is shuffled.

    Participants carry the columns of their match that reports filter and divide by, and what they were ahead of their lane
    opponent by, who is found among the participants of the document before these become rows.
    """
    empty = {n: F.array().cast(t) if t.startswith("array") else F.lit(0) for n, t in schemas.TIMELINE_COLUMNS.items()}

    def entry(raw, pos):
        # The participant's entry of the timeline is found by player id within the row.
        def with_timeline(p):
            own = F.get(F.filter("people", lambda q: q["puuid"] == p["puuid"]), F.lit(0))
            return F.struct(pos.alias("pos"), raw.alias("raw"), p.alias("p"), own.alias("t"), F.coalesce(match_parser.role_of(p), F.lit("")).alias("role"))

        return bound(F.from_json(raw, schemas.PARTICIPANT), with_timeline)

    carried = [c for c in champions.MATCH_COLUMNS if c != "patch"]
    inside = docs.select(
        "matchId",
        extract_patch("info.gameVersion").alias("patch"),
        *[F.col(f"info.{c}").alias(c) for c in carried],
        F.transform("info.participants", entry).alias("entries"),
    )
    def with_lane(e):
        def ahead(o):
            at15 = lambda x, series: at_or_zero(x["t"][series], players.LANING_MINUTE).cast("long")
            diffs = [F.when(o.isNotNull(), at15(e, s) - at15(o, s)).alias(n) for n, s in players.LANING.items()]
            return F.struct(o.isNotNull().alias("hasOpponent"), *diffs)

        lane = bound(lanes.opponent_among(F.col("entries"), e), ahead)
        return F.struct(*[e[c].alias(c) for c in ("pos", "raw", "p", "t")], lane.alias("ahead"))

    # The outer form, see parse_timelines.
    raw = inside.select(*[c for c in inside.columns if c != "entries"], F.inline_outer(F.transform("entries", with_lane))).where("pos IS NOT NULL")
    people = match_parser.participants_of(raw)
    people = people.select(
        *[c for c in people.columns if c not in ("t", "ahead")],
        *[F.coalesce(F.col(f"t.{n}"), e).alias(n) for n, e in empty.items()],
        "ahead.*",
    )
    return match_parser.match_rows(docs), match_parser.team_rows(docs), people


def laning_snapshot(participants: DataFrame) -> DataFrame:
    """Series of each participant in short: lengths, last cs, values at minute 15."""
    return participants.select(
        "matchId",
        "puuid",
        "role",
        F.size("goldGraph").alias("minutes"),
        last_or_zero("csGraph").alias("lastCs"),
        at_or_zero("goldGraph", 15).alias("gold15"),
        at_or_zero("xpGraph", 15).alias("xp15"),
        at_or_zero("csGraph", 15).alias("cs15"),
        F.size("skillOrder").alias("skills"),
        F.size("itemTimeline").alias("items"),
        details.final_build(F.col("itemTimeline")).alias("finalBuild"),
    )
