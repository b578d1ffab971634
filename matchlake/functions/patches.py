"""Game version and patch expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlake.functions.numeric import col

ALL_PATCHES = "ALL"


def extract_patch(version: Column | str) -> Column:
    """First two parts of a dotted version; a version of one part is returned whole."""
    parts = F.split(col(version), r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, 1, 2))).otherwise(col(version))


def previous_patch(patch: Column | str, padded: bool = False, last_minor: int = 23) -> Column:
    """The patch before: one minor down, or the last minor of the major before; null at the very first.

    `padded` writes the minor with two digits. `last_minor` is the minor a major ends with.
    """
    parts = F.split(col(patch), r"\.")
    major = F.get(parts, F.lit(0)).try_cast("int")
    minor = F.get(parts, F.lit(1)).try_cast("int")
    new_major = F.when(minor > 1, major).otherwise(major - 1)
    new_minor = F.when(minor > 1, minor - 1).otherwise(F.lit(last_minor)).cast("string")
    if padded:
        new_minor = F.when(F.length(new_minor) < 2, F.lpad(new_minor, 2, "0")).otherwise(new_minor)
    text = F.concat_ws(".", new_major.cast("string"), new_minor)
    return F.when((F.size(parts) >= 2) & ~((major <= 1) & (minor <= 1)), text)


def filter_patch(df: DataFrame, patch: str | None, match: str = "exact") -> DataFrame:
    """Keep one patch. 'ALL' or None keeps everything; match='prefix' compares with the first parts of gameVersion, whole parts only."""
    if patch is None or patch == ALL_PATCHES:
        return df
    if match == "exact":
        return df.where(F.col("patch") == patch)
    if match == "prefix":
        return df.where(F.concat(F.col("gameVersion"), F.lit(".")).startswith(f"{patch}."))
    raise ValueError(f"unknown patch match: {match}")
