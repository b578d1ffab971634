"""Match history: filters, order, offset and keyset pages for one player or for all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlake.functions.numeric import per_minute, rnd
from matchlake.functions.text import role_alias

RANKED_SOLO = 420
SORTS = {"recent": "gameCreation", "kda": "kda", "kills": "kills", "damage": "totalDamage"}
MAX_LIMIT = 50
#: Parts that a player's rows are ranked in first.
PARTS = 32
COLUMNS = [
    "puuid", "matchId", "championId", "championName", "role", "lane", "kills", "deaths", "assists", "kda", "goldEarned", "totalDamage",
    "visionScore", "cspm", "win", "gameCreation", "gameDuration", "queueId",
]


def filter_history(
    games: DataFrame,
    puuid=None,
    queue_id: int | None = RANKED_SOLO,
    champion_id: int | None = None,
    role: str | None = None,
    result: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """Conditions of the parameters that are given; dates are inclusive."""
    conditions: list[Column] = []
    if puuid is not None:
        conditions.append(F.col("puuid") == puuid)
    if queue_id is not None:
        conditions.append(F.col("queueId") == queue_id)
    if champion_id is not None:
        conditions.append(F.col("championId") == champion_id)
    if role is not None:
        conditions.append(F.col("role") == role_alias(role))
    if result is not None:
        if result not in ("win", "loss"):
            raise ValueError("result is win or loss")
        conditions.append(F.col("win") == (result == "win"))
    if start_ms is not None:
        conditions.append(F.col("gameCreation") >= start_ms)
    if end_ms is not None:
        conditions.append(F.col("gameCreation") <= end_ms)
    for c in conditions:
        games = games.where(c)
    return games


def history_rows(games: DataFrame) -> DataFrame:
    """Columns of a history entry of games with lastCs (champion_stats.with_last_cs)."""
    cspm = F.coalesce(rnd(per_minute("lastCs", "gameDuration"), 2), F.lit(0.0))
    for name in ("championName", "lane"):
        if name not in games.columns:
            games = games.withColumn(name, F.lit(None).cast("string"))
    return games.withColumn("cspm", cspm).select(*COLUMNS, *(["pos"] if "pos" in games.columns else []))


def _order(sort_by: str | None, columns: list[str]) -> list[Column]:
    key = SORTS.get(sort_by or "recent", "gameCreation")
    ties = [F.asc(c) for c in ("matchId", "pos", "championId", "goldEarned", "totalDamage") if c in columns and c != key]
    return [F.desc(key), *ties]


def _check(limit: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit is 1 to {MAX_LIMIT}")


def _head(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each player with their `place`, in two steps of any depth.

    A player's rows are ranked in parts first, so one with very many games fills no task, and only the heads of the
    parts are ranked together.
    """
    part = F.pmod(F.xxhash64("matchId"), F.lit(PARTS))
    parts = Window.partitionBy("puuid", "_part").orderBy(*order)
    heads = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(parts)).where(F.col("_at") <= n)
    whole = Window.partitionBy("puuid").orderBy(*order)
    return heads.drop("_part", "_at").withColumn("place", F.row_number().over(whole)).where(F.col("place") <= n)


def history_page(rows: DataFrame, page: int = 1, limit: int = 20, sort_by: str | None = None) -> DataFrame:
    """One page per player, with `hasMore` and `nextCursor`."""
    _check(limit)
    skip = (page - 1) * limit
    return _cut(_head(rows, skip + limit + 1, _order(sort_by, rows.columns)), skip, limit)


def _cut(ranked: DataFrame, skip: int, limit: int) -> DataFrame:
    # At most limit + 1 rows per player reach these windows.
    head = ranked.where(F.col("place") > skip)
    each = Window.partitionBy("puuid")
    more = F.max("place").over(each) > skip + limit
    last_id = F.max(F.when(F.col("place") == skip + limit, F.col("matchId"))).over(each)
    return (
        head.withColumn("hasMore", more)
        .withColumn("nextCursor", F.when(F.col("hasMore"), last_id))
        .where(F.col("place") <= skip + limit)
        .withColumn("place", F.col("place") - skip)
    )


def history_after(rows: DataFrame, cursors: DataFrame, limit: int = 20, sort_by: str | None = None) -> DataFrame:
    """Keyset page behind each player's cursor (puuid, cursor). An unknown cursor starts at the top.

    The cursor is the pair (sort key, matchId), so equal keys are neither lost nor repeated.
    """
    _check(limit)
    key = SORTS.get(sort_by or "recent", "gameCreation")
    at = (
        rows.join(cursors.select("puuid", F.col("cursor").alias("matchId")), ["puuid", "matchId"])
        .groupBy("puuid")
        .agg(F.min(key).alias("cursorKey"), F.max("matchId").alias("cursorId"))
    )
    behind = F.col("cursorKey").isNull() | (F.col(key) < F.col("cursorKey")) | (
        (F.col(key) == F.col("cursorKey")) & (F.col("matchId") > F.col("cursorId"))
    )
    kept = rows.join(at, "puuid", "left").where(behind).drop("cursorKey", "cursorId")
    return _cut(_head(kept, limit + 1, _order(sort_by, rows.columns)), 0, limit)


def count_history(games: DataFrame) -> DataFrame:
    """Number of matches behind a history filter, per player."""
    return games.groupBy("puuid").agg(F.count("*").alias("matches"))
