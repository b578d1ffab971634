"""Rounding, rates, and means that do not depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICRO = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(value: Column | str, digits: int = 2) -> Column:
    """Half away from zero on the double itself; `+ 0.0` turns a negative zero into zero."""
    v = col(value).cast("double")
    p = float(10**digits)
    return F.signum(v) * F.floor(F.abs(v) * p + 0.5) / p + F.lit(0.0)


def minutes(duration_seconds: Column | str) -> Column:
    return col(duration_seconds) / F.lit(60.0)


def per_minute(value: Column | str, duration_seconds: Column | str) -> Column:
    """value / (duration / 60), null for a zero duration."""
    return F.try_divide(col(value).cast("double"), minutes(duration_seconds))


def percent(part: Column | str, total: Column | str) -> Column:
    """part / total * 100, zero when there is no total."""
    return F.coalesce(F.try_divide(col(part).cast("double"), col(total)) * 100.0, F.lit(0.0))


def last_or_zero(series: Column | str) -> Column:
    s = col(series)
    return F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))


def at_or_zero(series: Column | str, index: int) -> Column:
    return F.coalesce(F.get(col(series), F.lit(index)), F.lit(0))


def kda(kills: Column | str, deaths: Column | str, assists: Column | str) -> Column:
    """(kills + assists) / deaths with zero deaths counted as one."""
    d = F.coalesce(col(deaths), F.lit(0))
    return (col(kills) + col(assists)) / F.when(d == 0, F.lit(1)).otherwise(d).cast("double")


def micros(value: Column | str) -> Column:
    """A double as whole millionths. Sums of these are exact, so they merge in any order."""
    return F.floor(col(value) * float(MICRO) + 0.5).cast("decimal(18,0)")


def mean_of_micros(total: Column | str, n: Column | str) -> Column:
    """Mean of values summed as millionths, zero when nothing was counted."""
    return F.coalesce(F.try_divide(col(total).cast("double") / float(MICRO), col(n)), F.lit(0.0))


def plain_number(value: Column | str, digits: int = 1) -> Column:
    """Rounded number as text, without a trailing `.0`."""
    text = rnd(value, digits).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text
