"""Champion score and tier."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchlake.functions.numeric import col

# Weights, normalisation limits, confidence bands and tier limits of the score.
WEIGHTS = {
    "winRate": 0.35,
    "banRate": 0.25,
    "pickRate": 0.15,
    "kda": 0.1,
    "dpm": 0.08,
    "gpm": 0.04,
    "cspm": 0.03,
}
FULL_KDA = 3.0
FULL_DPM = 1200
FULL_GPM = 600
FULL_CSPM = 8.5
CONFIDENCE = [(500, 1.0), (200, 0.97), (100, 0.94), (50, 0.9)]
MIN_GAMES = 50
INSUFFICIENT = "Dados Insuficientes"
TIERS = [(70, "S"), (55, "A"), (40, "B"), (30, "C")]

METRICS = ["winRate", "banRate", "pickRate", "kda", "dpm", "gpm", "cspm", "gamesPlayed"]


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def normalised(m: dict[str, Column]) -> dict[str, Column]:
    """Each metric on 0..100; kda has an upper limit only."""
    return {
        "winRate": _clamp((m["winRate"] - 45) * 10),
        "banRate": _clamp(m["banRate"] * 10),
        "pickRate": _clamp(m["pickRate"]),
        "kda": F.least(F.lit(100.0), m["kda"] / FULL_KDA * 100),
        "dpm": _clamp(m["dpm"] / FULL_DPM * 100),
        "gpm": _clamp(m["gpm"] / FULL_GPM * 100),
        "cspm": _clamp(m["cspm"] / FULL_CSPM * 100),
    }


def confidence(games: Column | str) -> Column:
    out = F.lit(0.0)
    for limit, factor in reversed(CONFIDENCE):
        out = F.when(col(games) >= limit, F.lit(factor)).otherwise(out)
    return out


def base_score(m: dict[str, Column]) -> Column:
    parts = normalised(m)
    total = None
    for name, weight in WEIGHTS.items():
        term = parts[name] * weight
        total = term if total is None else total + term
    return total


def adjusted_score(m: dict[str, Column]) -> Column:
    return base_score(m) * confidence(m["gamesPlayed"])


def tier(score: Column, win_rate: Column, ban_rate: Column) -> Column:
    out = F.lit("D")
    for limit, name in reversed(TIERS):
        out = F.when(score >= limit, F.lit(name)).otherwise(out)
    return F.when((score >= 80) & (win_rate > 51) & (ban_rate > 5), F.lit("S+")).otherwise(out)


def champion_score(now: dict[str, Column], before: dict[str, Column]) -> Column:
    """Score of a patch, mixed with the patch before when that one has enough games."""
    current = adjusted_score(now)
    mixed = current * 0.7 + adjusted_score(before) * 0.3
    d_win = now["winRate"] - before["winRate"]
    d_ban = now["banRate"] - before["banRate"]
    mixed = (
        F.when((d_win > 2) & (d_ban > 1), mixed + 5)
        .when((d_win < -2) & (d_ban < -1), mixed - 5)
        .otherwise(mixed)
    )
    return (
        F.when(now["gamesPlayed"] < MIN_GAMES, F.lit(0.0))
        .when(before["gamesPlayed"] >= MIN_GAMES, mixed)
        .otherwise(current)
    )
