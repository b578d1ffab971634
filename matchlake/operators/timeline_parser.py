"""Timeline documents to per-participant series, positions, items, skills, and match objectives.

A timeline is one row, so everything is computed inside the row with array functions: no shuffle,
no explode of frames or events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlake.functions.nested import bound
from matchlake.sources import schemas

# Series length without frames, milliseconds of a minute, the solo-kill limit, skill letters.
DEFAULT_MINUTES = 40
MINUTE_MS = 60000
SOLO_LIMIT_MS = 15 * MINUTE_MS
SKILLS = {1: "Q", 2: "W", 3: "E", 4: "R"}
USED_TYPES = [
    "CHAMPION_KILL", "WARD_PLACED", "WARD_KILL", "ITEM_PURCHASED", "ITEM_SOLD", "ITEM_UNDO",
    "SKILL_LEVEL_UP", "ELITE_MONSTER_KILL", "BUILDING_KILL",
]
ITEM_TYPES = ["ITEM_PURCHASED", "ITEM_SOLD", "ITEM_DESTROYED", "ITEM_UNDO"]


def series_minutes(frames: Column) -> Column:
    """ceil(last timestamp / minute); zero or no frames count as the default length."""
    last = F.try_element_at(frames, F.lit(-1))["timestamp"]
    return F.coalesce(F.nullif(F.ceil(last / MINUTE_MS).cast("int"), F.lit(0)), F.lit(DEFAULT_MINUTES))


def all_events(frames: Column) -> Column:
    return F.flatten(F.transform(frames, lambda f: F.coalesce(f["events"], F.array())))


def skill_letter(slot: Column) -> Column:
    out = F.lit("?")
    for number, letter in SKILLS.items():
        out = F.when(slot == number, F.lit(letter)).otherwise(out)
    return out


def _frames_of(frames: Column, pid: Column) -> Column:
    """The frames that hold a participant, in document order."""
    return F.filter(
        F.transform(
            frames,
            lambda f: F.struct(
                F.floor(f["timestamp"] / MINUTE_MS).cast("int").alias("minute"),
                f["timestamp"].alias("time"),
                F.try_element_at(f["participantFrames"], pid.cast("string")).alias("v"),
            ),
        ),
        lambda e: e["v"].isNotNull(),
    )


def by_minute(own: Column, length: Column) -> Column:
    """A participant's frames scattered into one slot a minute, in one pass: the last frame of a minute counts, minutes
    without one are null."""
    nothing = lambda n: F.array_repeat(F.lit(None).cast(schemas.PARTICIPANT_FRAME), F.greatest(n, F.lit(0)))

    def scattered(places: Column) -> Column:
        # A frame fills its slot, and the empty ones up to the next frame's.
        def slot(at: Column, i: Column) -> Column:
            after = F.coalesce(F.get(places, i + 1)["minute"], length)
            filled = F.concat(F.array(F.get(own, at["place"])["v"]), nothing(after - at["minute"] - 1))
            return F.when(after == at["minute"], F.array().cast(f"array<{schemas.PARTICIPANT_FRAME}>")).otherwise(filled)

        return F.concat(nothing(F.coalesce(F.get(places, F.lit(0))["minute"], length)), F.flatten(F.transform(places, slot)))

    places = F.transform(own, lambda e, i: F.struct(e["minute"].alias("minute"), i.alias("place")))
    return bound(F.sort_array(F.filter(places, lambda p: p["minute"] >= 0)), scattered)


def _series(per_minute: Column, value) -> Column:
    return F.transform(per_minute, lambda v: F.coalesce(value(v), F.lit(0)).cast("int"))


# What an event is to a participant; the numbers are places in a key and mean nothing else.
KILL, DEATH, WARD, ITEM, SKILL, SOLO_KILL, KINDS = range(7)
_ENTRY = "struct<key: int, place: int, x: int, y: int, timestamp: bigint, number: int, name: string>"


def participant_events(events: Column) -> Column:
    """All events that concern a participant, one entry for each, by participant and kind, then in document order.

    Every event is looked at once. A kill is an entry of its killer and one of its victim. Wards carry no position in the
    documents: both coordinates are 0. number is the item, or 1 for an early death without assistants.
    """

    def entries(e: Column, i: Column) -> Column:
        kind, item = e["type"], e["type"].isin("ITEM_PURCHASED", "ITEM_SOLD", "ITEM_UNDO")
        early = e["timestamp"] < SOLO_LIMIT_MS
        solo = (kind == "CHAMPION_SPECIAL_KILL") & (e["killType"] == "KILL_SOLO") & early
        alone = early & (F.coalesce(F.size(e["assistingParticipantIds"]), F.lit(0)) <= 0)

        def entry(second: int, pid: Column, what, number=None, name=None, placed=True) -> Column:
            x, y = (e["position"]["x"], e["position"]["y"]) if placed else (F.lit(0), F.lit(0))
            made = F.struct(
                (pid * KINDS + what).alias("key"), (2 * i + second).alias("place"), x.alias("x"), y.alias("y"), e["timestamp"].alias("timestamp"),
                (F.lit(None) if number is None else number).cast("int").alias("number"), (F.lit(None) if name is None else name).cast("string").alias("name"),
            ).cast(_ENTRY)
            return F.when(pid.isNotNull(), made)

        undo = kind == "ITEM_UNDO"
        word = F.when(kind == "ITEM_PURCHASED", F.lit("BUY")).when(undo, F.lit("UNDO")).otherwise(F.lit("SELL"))
        first = (
            F.when(kind == "CHAMPION_KILL", entry(0, e["killerId"], KILL))
            .when(kind == "WARD_PLACED", entry(0, e["creatorId"], WARD, name=e["wardType"], placed=False))
            .when(item, entry(0, e["participantId"], ITEM, F.when(undo, e["beforeId"]).otherwise(e["itemId"]), word))
            .when(kind == "SKILL_LEVEL_UP", entry(0, e["participantId"], SKILL, name=skill_letter(e["skillSlot"])))
            .when(solo, entry(0, e["killerId"], SOLO_KILL))
        )
        second = F.when(kind == "CHAMPION_KILL", entry(1, e["victimId"], DEATH, F.when(alone, F.lit(1))))
        return F.array(first, second)

    found = F.filter(F.flatten(F.transform(events, entries)), lambda x: x.isNotNull())
    return F.sort_array(found)


def entry_spans(entries: Column) -> Column:
    """key -> first place and number of its entries, as they lie side by side."""
    begins = F.filter(
        F.transform(entries, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"))),
        lambda m: (m["at"] == 0) | (F.get(entries, m["at"] - 1)["key"] != m["key"]),
    )

    def spans(marks: Column) -> Column:
        end = lambda j: F.coalesce(F.get(marks, j + 1)["at"], F.size(entries))
        return F.transform(marks, lambda m, j: F.struct(m["key"], F.struct((m["at"] + 1).alias("at"), (end(j) - m["at"]).alias("n"))))

    return F.map_from_entries(bound(begins, spans))


def apply_undos(items: Column) -> Column:
    """Ordered fold: an UNDO removes the latest BUY of its item that is still there, then is appended itself."""

    def without_last_buy(done: Column, item: Column) -> Column:
        places = F.transform(
            done, lambda x, i: F.when((x["type"] == "BUY") & (x["itemId"] == item), i).otherwise(F.lit(-1))
        )
        last = F.coalesce(F.array_max(places), F.lit(-1))
        return F.concat(
            F.slice(done, F.lit(1), F.greatest(last, F.lit(0))),
            F.slice(done, last + 2, F.greatest(F.size(done) - last - 1, F.lit(0))),
        )

    def step(done: Column, e: Column) -> Column:
        before = F.when(e["type"] == "UNDO", without_last_buy(done, e["itemId"])).otherwise(done)
        return F.concat(before, F.array(e))

    folded = F.aggregate(items, F.array().cast(schemas.ITEMS), step)
    return F.when(F.exists(items, lambda e: e["type"] == "UNDO"), folded).otherwise(items.cast(schemas.ITEMS))


def with_results(df: DataFrame) -> DataFrame:
    """Replaces `ids` (participant list) and `frames` by `people` and `objectives`, computed inside the row.

    `people` holds one struct per listed participant with all series and histories; other columns stay.
    """
    rest = [c for c in df.columns if c not in ("ids", "frames")]
    base = df.withColumns({"ids": F.coalesce("ids", F.array()), "frames": F.coalesce("frames", F.array())})
    staged = base.select(
        *rest,
        "ids",
        "frames",
        series_minutes(F.col("frames")).alias("minutes"),
        all_events(F.col("frames")).alias("events"),
    )
    keyed = staged.select(
        *rest,
        "minutes",
        participant_events(F.col("events")).alias("entries"),
        objective_array(F.col("events")).alias("objectives"),
        F.transform(
            "ids",
            lambda puuid, i: F.struct(
                (i + 1).alias("pid"), puuid.alias("puuid"), _frames_of(F.col("frames"), i + 1).alias("own")
            ),
        ).alias("people"),
    )
    spanned = keyed.withColumn("spans", entry_spans(F.col("entries")))
    # A frame past the planned length makes the series longer.
    last = lambda q: F.coalesce(F.array_max(F.transform(q["own"], lambda e: e["minute"])) + 1, F.lit(0))
    minuted = spanned.withColumn(
        "people",
        F.transform(
            "people",
            lambda q: F.struct(
                q["pid"].alias("pid"),
                q["puuid"].alias("puuid"),
                q["own"].alias("own"),
                by_minute(q["own"], F.greatest(F.col("minutes"), last(q))).alias("byMinute"),
            ),
        ),
    )
    return minuted.select(
        *rest,
        F.transform("people", lambda q: _result(q, F.col("entries"), F.col("spans"))).alias("people"),
        "objectives",
    )


def _result(q: Column, entries: Column, spans: Column) -> Column:
    pid, series = q["pid"], q["byMinute"]

    def own(kind: int) -> Column:
        found = bound(F.try_element_at(spans, pid * KINDS + kind), lambda s: F.slice(entries, s["at"], s["n"]))
        return F.coalesce(found, F.array().cast(f"array<{_ENTRY}>"))

    where = lambda e: [e[c].alias(c) for c in ("x", "y", "timestamp")]
    items = F.transform(own(ITEM), lambda e: F.struct(e["number"].alias("itemId"), e["timestamp"], e["name"].alias("type")))
    columns = {
        "goldGraph": _series(series, lambda v: v["totalGold"]),
        "xpGraph": _series(series, lambda v: v["xp"]),
        "csGraph": _series(series, lambda v: v["minionsKilled"] + v["jungleMinionsKilled"]),
        "damageGraph": _series(series, lambda v: v["damageStats"]["totalDamageDoneToChampions"]),
        "deathPositions": F.transform(own(DEATH), lambda e: F.struct(*where(e))),
        "killPositions": F.transform(own(KILL), lambda e: F.struct(*where(e))),
        "wardPositions": F.transform(own(WARD), lambda e: F.struct(*where(e), e["name"].alias("wardType"))),
        "pathingSample": F.transform(
            q["own"],
            lambda e: F.struct(
                e["v"]["position"]["x"].alias("x"), e["v"]["position"]["y"].alias("y"), e["time"].alias("time")
            ),
        ),
        "skillOrder": F.transform(own(SKILL), lambda e: e["name"]),
        "itemTimeline": bound(items, apply_undos),
        "soloKills15": F.size(own(SOLO_KILL)),
        "soloDeaths15": F.size(F.filter(own(DEATH), lambda e: e["number"] == 1)),
    }
    return F.struct(
        q["puuid"].alias("puuid"),
        pid.alias("participantId"),
        *[columns[n].cast(t).alias(n) for n, t in schemas.TIMELINE_COLUMNS.items()],
    )


def timeline_results(timelines: DataFrame) -> DataFrame:
    """(matchId, people, objectives), one row per timeline."""
    return with_results(
        timelines.select(
            F.col("metadata.matchId").alias("matchId"),
            F.col("metadata.participants").alias("ids"),
            F.col("info.frames").alias("frames"),
        )
    )


def parse_timelines(timelines: DataFrame) -> DataFrame:
    """One row per mapped participant with all series and histories.

    The outer form: for the inner one the optimizer adds a filter on the array's size and moves it below, with all that makes the
    array written out in it.
    """
    return timeline_results(timelines).select("matchId", F.inline_outer("people")).where("participantId IS NOT NULL")


def objectives(timelines: DataFrame) -> DataFrame:
    """Elite monster and building kills, one row each, with their order in the match."""
    events = all_events(F.coalesce("info.frames", F.array()))
    return (
        timelines.select(F.col("metadata.matchId").alias("matchId"), F.posexplode(objective_array(events)).alias("place", "o"))
        .select("matchId", "place", "o.*")
    )


def objective_array(events: Column) -> Column:
    elite = lambda e: e["type"] == "ELITE_MONSTER_KILL"
    return F.transform(
        F.filter(events, lambda e: e["type"].isin("ELITE_MONSTER_KILL", "BUILDING_KILL")),
        lambda e: F.struct(
            F.when(elite(e), e["monsterType"])
            .when(e["buildingType"] == "INHIBITOR_BUILDING", F.lit("INHIBITOR"))
            .otherwise(F.lit("TOWER"))
            .alias("type"),
            F.when(elite(e), F.nullif(e["monsterSubType"], F.lit(""))).otherwise(e["laneType"]).alias("subType"),
            F.when(elite(e), e["killerTeamId"]).otherwise(e["teamId"]).alias("teamId"),
            e["timestamp"].alias("timestamp"),
            e["killerId"].alias("killerId"),
        ),
    ).cast(schemas.OBJECTIVES)


def classified_events(timelines: DataFrame) -> DataFrame:
    """Every event with its class flags and whether the parser uses it."""
    kind = F.col("e.type")
    return timelines.select(
        F.col("metadata.matchId").alias("matchId"), F.explode(all_events(F.col("info.frames"))).alias("e")
    ).select(
        "matchId",
        kind.alias("type"),
        F.col("e.timestamp").alias("timestamp"),
        (kind == "CHAMPION_KILL").alias("isKill"),
        kind.isin("WARD_PLACED", "WARD_KILL").alias("isWard"),
        kind.isin(ITEM_TYPES).alias("isItem"),
        (kind == "ELITE_MONSTER_KILL").alias("isElite"),
        kind.isin(USED_TYPES).alias("isUsed"),
    )
