"""Team gold per minute and what can be read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLUE, RED = 100, 200
SWING_LIMIT = 3000


# Minutes summed side by side in one row; the number of such rows per match follows the length of its series.
CHUNK = 16


def gold_timeline(participants: DataFrame) -> DataFrame:
    """Gold of both teams for every minute up to the match's longest series; a shorter series counts as 0.

    A series is cut into chunks of 16 minutes and the minutes of a chunk are summed as columns. That makes a
    few rows per participant instead of one per minute, and they are reduced per match before the shuffle.
    """
    length = F.size("goldGraph")
    parts = F.when(length > 0, F.sequence(F.lit(0), F.floor((length - 1) / CHUNK).cast("int")))
    # explode_outer: a plain explode would also test the series below the scan, computing it twice.
    chunks = participants.select(
        "matchId", "teamId", "goldGraph", length.alias("length"), F.explode_outer(parts).alias("chunk")
    ).where(F.col("chunk").isNotNull())
    first = F.col("chunk") * CHUNK
    gold = [F.get("goldGraph", first + i) for i in range(CHUNK)]
    team = lambda t, i: F.coalesce(F.sum(F.when(F.col("teamId") == t, gold[i])), F.lit(0))
    sums = chunks.groupBy("matchId", "chunk").agg(
        F.max("length").alias("length"),
        *[team(BLUE, i).alias(f"b{i}") for i in range(CHUNK)],
        *[team(RED, i).alias(f"r{i}") for i in range(CHUNK)],
    )
    minutes = F.array(
        *[
            F.struct((first + i).alias("minute"), F.col(f"b{i}").alias("blueTeam"), F.col(f"r{i}").alias("redTeam"))
            for i in range(CHUNK)
        ]
    )
    return (
        sums.select("matchId", "length", F.inline(minutes))
        .where(F.col("minute") < F.col("length"))
        .select("matchId", "minute", "blueTeam", "redTeam", (F.col("blueTeam") - F.col("redTeam")).alias("difference"))
    )


def gold_insights(timeline: DataFrame, matches: DataFrame | None = None, limit: int = SWING_LIMIT) -> DataFrame:
    """Winner by the last minute, first largest advantage, first swing above the limit.

    `matches` adds the matches without any gold data: red wins, nothing else is known.
    """
    w = Window.partitionBy("matchId").orderBy("minute")
    before = F.lag("difference").over(w)
    swings = timeline.withColumn("before", before).withColumn("swing", F.abs(F.col("difference") - F.col("before")))
    lead = F.struct(F.abs("difference").alias("size"), (-F.col("minute")).alias("early"), "difference")
    throw = F.struct("minute", "before", F.col("difference").alias("after"), "swing")
    out = swings.groupBy("matchId").agg(
        F.max_by("difference", "minute").alias("final"),
        F.max(lead).alias("lead"),
        F.min(F.when(F.col("swing") > limit, throw)).alias("throw"),
    )
    if matches is not None:
        out = matches.select("matchId").join(out, "matchId", "left")
    side = lambda c: F.when(c > 0, F.lit("blueTeam")).otherwise(F.lit("redTeam"))
    return out.select(
        "matchId",
        side(F.col("final")).alias("winner"),
        (-F.col("lead.early")).alias("maxAdvantageMinute"),
        F.when(F.col("lead").isNotNull(), side(F.col("lead.difference"))).alias("maxAdvantageTeam"),
        F.col("lead.size").alias("maxAdvantage"),
        F.col("throw.minute").alias("throwMinute"),
        F.col("throw.before").alias("throwBefore"),
        F.col("throw.after").alias("throwAfter"),
        F.col("throw.swing").alias("throwSwing"),
    )
