"""Requests per key in a trailing window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from matchlake.functions.text import key_pseudonym

WINDOW_SECONDS = 120
MAX_REQUESTS = 100


def request_window(requests: DataFrame, window_seconds: int = WINDOW_SECONDS, limit: int = MAX_REQUESTS) -> DataFrame:
    """For each request time (key, ts_ms): requests of the key in (ts - window, ts], and whether one more fits.

    Two requests in one millisecond count once. Time is cut into buckets of one window length; every row
    is also shown to the next bucket, so a window never needs more than its own bucket and the one before.
    A key of any size is thus spread over its buckets, each with at most 2000 rows per second of window.
    """
    span = window_seconds * 1000
    own = F.floor(F.col("ts_ms") / span).cast("long")
    once = requests.select(key_pseudonym("key").alias("keyId"), "ts_ms").distinct()
    shown = once.withColumn("own", own).withColumn("bucket", F.explode(F.array("own", F.col("own") + 1)))
    w = Window.partitionBy("keyId", "bucket").orderBy("ts_ms").rangeBetween(-(span - 1), Window.currentRow)
    return (
        shown.withColumn("requestsInWindow", F.count("*").over(w))
        .where(F.col("bucket") == F.col("own"))
        .select(
            "keyId",
            "ts_ms",
            "requestsInWindow",
            F.lit(limit).alias("maxRequests"),
            (F.col("requestsInWindow") < limit).alias("canProceed"),
        )
    )
