"""Names, image links, roles, key pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchlake.functions.numeric import col

# Public address of the game's static champion images, lane names, weekday names.
IMAGE_BASE = "https://ddragon.leagueoflegends.com/cdn"
LANES = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
ROLE_ALIASES = {"MID": "MIDDLE"}
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def normalise_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(name)), r"\s", "")


def image_urls(champion_id: Column | str, version: Column | str, base: str = IMAGE_BASE) -> Column:
    """Struct of the square, loading and splash image links of a champion."""
    cid, ver = col(champion_id), col(version)
    return F.struct(
        F.concat(F.lit(f"{base}/"), ver, F.lit("/img/champion/"), cid, F.lit(".png")).alias("square"),
        F.concat(F.lit(f"{base}/img/champion/loading/"), cid, F.lit("_0.jpg")).alias("loading"),
        F.concat(F.lit(f"{base}/img/champion/splash/"), cid, F.lit("_0.jpg")).alias("splash"),
    )


def day_name(dow: Column | str) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), col(dow).cast("int"))


def role_alias(role: str) -> str:
    """Accept the short lane name where the stored one is longer."""
    return ROLE_ALIASES.get(role, role)


def first_filled(*names: Column) -> Column:
    """First argument that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))


def key_pseudonym(key: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of a key; a missing key counts as `default`."""
    return F.coalesce(F.substring(F.sha2(col(key), 256), 1, 16), F.lit("default"))
