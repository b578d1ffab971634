"""Local weekday and hour of an epoch value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchlake.functions.numeric import col

LOCAL_ZONE = "America/Sao_Paulo"


def local_time(epoch_ms: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time in `zone`. Works on zone-less timestamps, so the session zone has no influence."""
    seconds = F.floor(col(epoch_ms) / F.lit(1000)).cast("long")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_dow(epoch_ms: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Day of week, 0 is Sunday."""
    return F.dayofweek(local_time(epoch_ms, zone)) - 1


def local_hour(epoch_ms: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.hour(local_time(epoch_ms, zone))


def epoch_ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a zone-less timestamp, read as UTC."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts)) / 1000).cast("long")


def minute_of(ts_ms: Column | str) -> Column:
    return F.floor(col(ts_ms) / F.lit(60000)).cast("int")
