"""When players play: the 7 x 24 heatmap and its insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchlake.functions.numeric import percent
from matchlake.functions.text import day_name
from matchlake.functions.timeparts import LOCAL_ZONE, local_dow, local_hour

CELLS = 7 * 24
MIN_CELL_GAMES = 5


def activity_cells(games: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Games, wins and losses per player and local weekday and hour; observed cells only."""
    return (
        games.select(
            "puuid",
            local_dow("gameCreation", zone).alias("dayOfWeek"),
            local_hour("gameCreation", zone).alias("hour"),
            "win",
        )
        .groupBy("puuid", "dayOfWeek", "hour")
        .agg(F.count("*").alias("games"), F.sum(F.col("win").cast("long")).alias("wins"))
        .select(
            "puuid",
            "dayOfWeek",
            "hour",
            "games",
            "wins",
            (F.col("games") - F.col("wins")).alias("losses"),
            percent("wins", "games").alias("winRate"),
        )
    )


def heatmap(cells: DataFrame) -> DataFrame:
    """All 168 cells of every player, zeros where nothing was played; `place` orders them by day and hour.

    A player has at most 168 cells, so they fit in one map; the grid is generated beside it and looked up,
    which needs neither a cross join nor a second copy of the players.
    """
    place = (F.col("dayOfWeek") * 24 + F.col("hour")).cast("int")
    packed = cells.groupBy("puuid").agg(
        F.map_from_entries(
            F.collect_list(F.struct(place.alias("cell"), F.struct("games", "wins", "losses", "winRate").alias("v")))
        ).alias("seen")
    )
    grid = packed.select("puuid", "seen", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    v = F.try_element_at("seen", "cell")
    zero = lambda name, z: F.coalesce(v[name], F.lit(z)).alias(name)
    return grid.select(
        "puuid",
        F.floor(F.col("cell") / 24).cast("int").alias("dayOfWeek"),
        (F.col("cell") % 24).alias("hour"),
        (F.col("cell") + 1).alias("place"),
        zero("games", 0),
        zero("wins", 0),
        zero("losses", 0),
        zero("winRate", 0.0),
    )


def activity_insights(cells: DataFrame) -> DataFrame:
    """Busiest day, hour of the busiest cell, best and worst win rate among cells with enough games.

    The earlier day and hour win ties. One aggregation per player.
    """
    place = F.col("dayOfWeek") * 24 + F.col("hour")
    rated = F.col("games") >= MIN_CELL_GAMES
    per_player = cells.groupBy("puuid").agg(
        *[F.sum(F.when(F.col("dayOfWeek") == d, F.col("games")).otherwise(0)).alias(f"day{d}") for d in range(7)],
        F.max(F.struct("games", (-place).alias("early"))).alias("busiest"),
        F.max(F.when(rated, F.struct("winRate", (-place).alias("early")))).alias("best"),
        F.min(F.when(rated, F.struct("winRate", place.alias("early")))).alias("worst"),
    )
    days = F.array(*[F.col(f"day{d}") for d in range(7)])

    def label(cell):
        text = F.concat(day_name(F.floor(cell / 24)), F.lit(" "), (cell % 24).cast("string"), F.lit("h"))
        return F.coalesce(text, F.lit("N/A"))

    return per_player.withColumn("days", days).select(
        "puuid",
        day_name(F.array_position("days", F.array_max("days")) - 1).alias("mostActiveDay"),
        F.array_max("days").alias("mostActiveDayGames"),
        ((-F.col("busiest.early")) % 24).alias("mostActiveHour"),
        F.col("busiest.games").alias("mostActiveHourGames"),
        F.coalesce("best.winRate", F.lit(0.0)).alias("peakWinRate"),
        label(-F.col("best.early")).alias("peakWinRateTime"),
        F.coalesce("worst.winRate", F.lit(0.0)).alias("worstWinRate"),
        label(F.col("worst.early")).alias("worstWinRateTime"),
    )


def day_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("puuid", "dayOfWeek").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"))
