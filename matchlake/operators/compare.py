"""Player against player: averaged timelines, laning, and worded insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlake.functions.numeric import plain_number, rnd
from matchlake.operators import player_stats as players

SIDES = ("hero", "villain")
STATS = {"winRate": 2, "avgKda": 2, "avgCspm": 1, "avgDpm": 1, "avgGpm": 1, "avgVisionScore": 1}
LANING = ["avgCsd15", "avgGd15", "avgXpd15"]

# Thresholds and message texts of the insights.
CS_PERCENT, CSD, VISION, DPM_PERCENT = 10, 3, 5, 10
TEXTS = {
    "hero_cs": ("Herói tem ", "% mais CS/min"),
    "villain_cs": ("Vilão tem ", "% mais CS/min"),
    "hero_csd": ("Herói tem +", " CSD@15"),
    "villain_csd": ("Vilão tem +", " CSD@15"),
    "hero_vision": ("Herói tem +", " vision score"),
    "villain_vision": ("Vilão tem +", " vision score"),
    "hero_dpm": ("Herói tem ", "% mais DPM"),
    "villain_dpm": ("Vilão tem ", "% mais DPM"),
    "better_kda": "Herói converte melhor suas vantagens em vitórias apesar de KDA inferior",
    "farm": "Herói deve melhorar farm e controle de wave",
    "lane": "Herói deve focar em domínio de lane nos primeiros 15 min",
    "wards": "Herói deve comprar mais wards e melhorar vision control",
    "fights": "Herói deve participar mais de teamfights e buscar trades",
    "convert": "Herói tem KDA superior mas winrate inferior — deve converter vantagens em objetivos",
}


def timeline_games(games: DataFrame, sample: int | None = None) -> DataFrame:
    """The games of each player that enter the averaged timelines: all, or the latest ones if a number is given."""
    if sample is None:
        return games
    ties = [c for c in ("pos", "championId", "goldEarned", "totalDamage") if c in games.columns]
    w = Window.partitionBy("puuid").orderBy(F.desc("gameCreation"), "matchId", *ties)
    return games.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= sample).drop("_place")


def average_timeline(games: DataFrame, column: str) -> DataFrame:
    """Mean per minute over the games that last that long, rounded to whole numbers, half up.

    A series moves once and whole, to its player, and is unpacked there: summed before the move, a minute would be a row that is
    larger than its value, as few games of a player meet in a task.
    """
    return (
        games.select("puuid", column)
        .repartition("puuid")
        .select("puuid", F.posexplode(column).alias("minute", "v"))
        .groupBy("puuid", "minute")
        .agg(F.sum("v").alias("total"), F.count("v").alias("n"))
        .select("puuid", "minute", F.floor(F.col("total").cast("double") / F.col("n") + 0.5).alias("value"))
    )


def sides_of(pairs: DataFrame) -> DataFrame:
    """(hero, villain, side, puuid): each distinct pair once for each of its sides."""
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("puuid")) for s in SIDES])
    return pairs.select("hero", "villain").distinct().select("hero", "villain", F.explode(both).alias("s")).select("hero", "villain", "s.*")


def compare_stats(pairs: DataFrame, users: DataFrame, stats: DataFrame, laning: bool = False) -> DataFrame:
    """Both players' profile and stats side by side, each pair once; pairs with an unknown player fall out.

    `stats` has one row per player. Laning values are zero unless the stats are those of one champion. Pairs are laid out by
    side, meet users and stats once, and are put back side by side; further columns of `stats` come along.
    """
    shown = {n: rnd(n, d) for n, d in STATS.items()} | {n: rnd(n, 1) if laning else F.lit(0.0) for n in LANING}
    known = ["puuid", "gamesPlayed", *shown, "soloKills15", "soloDeaths15"]
    more = [c for c in stats.columns if c not in known and c not in ("patch", "queueId", "championId", "lastPlayedAt", "wins", "losses")]
    people = sides_of(pairs).join(users.select("puuid", "gameName"), "puuid").join(stats, "puuid")
    names = ["gameName", "gamesPlayed", *shown, "soloKills15", "soloDeaths15", *more]
    one = F.struct(*[shown.get(n, F.col(n)).alias(n) for n in names])
    pivoted = people.groupBy("hero", "villain").agg(*[F.any_value(F.when(F.col("side") == s, one), True).alias(s + "_") for s in SIDES])
    return pivoted.where(" AND ".join(f"{s}_ IS NOT NULL" for s in SIDES)).select(
        "hero", "villain", *[F.col(f"{s}_.{n}").alias(s + n[0].upper() + n[1:]) for s in SIDES for n in names]
    )


def _both(name: str) -> tuple[Column, Column]:
    n = name[0].upper() + name[1:]
    return F.col("hero" + n), F.col("villain" + n)


def _say(key: str, value: Column) -> Column:
    before, after = TEXTS[key]
    return F.concat(F.lit(before), plain_number(value), F.lit(after))


def with_insights(compared: DataFrame) -> DataFrame:
    """Winner, advantages and recommendations in rule order."""
    cs = _relative("avgCspm")
    dpm = _relative("avgDpm")
    h, v = _both("avgCsd15")
    csd = h - v
    h, v = _both("avgVisionScore")
    vision = h - v
    hero_kda, villain_kda = _both("avgKda")
    hero_wr, villain_wr = _both("winRate")

    rules = [
        (cs, CS_PERCENT, "hero_cs", "villain_cs", "farm"),
        (csd, CSD, "hero_csd", "villain_csd", "lane"),
        (vision, VISION, "hero_vision", "villain_vision", "wards"),
        (dpm, DPM_PERCENT, "hero_dpm", "villain_dpm", "fights"),
    ]
    ahead = [F.when(d > t, _say(hero, d)).when(d < -t, _say(villain, -d)) for d, t, hero, villain, _ in rules]
    advice = [F.when(d < -t, F.lit(TEXTS[tip])) for d, t, _, _, tip in rules]
    unused = (hero_kda > villain_kda) & (hero_wr < villain_wr)
    efficient = (villain_kda > hero_kda) & (villain_wr < hero_wr)
    ahead.append(F.when(~unused & efficient, F.lit(TEXTS["better_kda"])))
    advice.append(F.when(unused, F.lit(TEXTS["convert"])))
    return compared.withColumns(
        {
            "winner": F.when(hero_wr >= villain_wr, F.lit("hero")).otherwise(F.lit("villain")),
            "advantages": F.array_compact(F.array(*ahead)),
            "recommendations": F.array_compact(F.array(*advice)),
        }
    )


def _relative(name: str) -> Column:
    """Difference in percent of the villain's value; null unless both are positive."""
    h, v = _both(name)
    return F.when((h > 0) & (v > 0), F.try_divide(h - v, v) * 100)


def compare_timelines(pairs: DataFrame, averages: DataFrame) -> DataFrame:
    """One row per pair, side and minute."""
    return sides_of(pairs).join(averages, "puuid").drop("puuid")


def stats_and_series(games: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rates and laning of each player, and the averaged series as arrays by minute, from one pass over the games.

    `columns` names the result of each series column. A minute is averaged over the games that last that long. A game is a row
    for each of its minutes, the first of which carries its sums; a game without a series has that row alone.
    """
    zipped = F.posexplode_outer(F.arrays_zip(*columns)).alias("minute", "v")
    single = ["win", "kda", "dpm", "gpm", "cspm", "visionScore", "hasOpponent", *players.LANING, *[c for c in players.SOLO if c in games.columns], "gameCreation"]
    rows = games.select("puuid", *single, zipped).withColumn("minute", F.coalesce("minute", F.lit(0)))
    first = F.col("minute") == 0
    rows = rows.withColumns({c: F.when(first, F.col(c)) for c in single})
    sums = [*[F.sum(f"v.{c}").alias(f"_{c}") for c in columns], *[F.count(f"v.{c}").alias(f"_n{c}") for c in columns]]
    once = rows.groupBy("puuid", "minute").agg(*players.game_sums(games.columns, F.count_if(first)), *sums)
    mean = lambda c: F.floor(F.col(f"_{c}").cast("double") / F.col(f"_n{c}") + 0.5).alias(c)
    # A player has as many rows here as the longest game has minutes; all but one add nothing to the sums.
    listed = F.sort_array(F.collect_list(F.struct("minute", *[mean(c) for c in columns]))).alias("_m")
    wide = once.groupBy("puuid").agg(
        *[F.sum(c).cast(once.schema[c].dataType).alias(c) for c in once.columns if c not in ("puuid", "minute", "lastPlayedAt") and not c.startswith("_")],
        F.max("lastPlayedAt").alias("lastPlayedAt"),
        listed,
    )

    def values(c: str) -> Column:
        return F.transform(F.filter("_m", lambda m: m[c].isNotNull()), lambda m: m[c])

    return wide.select("puuid", *players.rates(), *players.laning_rates(), *[values(c).alias(n) for c, n in columns.items()])
