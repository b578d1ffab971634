import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from matchlake.operators import details, match_parser, timeline_parser
from matchlake.plans import reports
from matchlake.sources import documents, schemas


def person(puuid="p1", **kw):
    base = dict(
        puuid=puuid, summonerName="n", championId=41, championName="Forty One", teamId=100, teamPosition="TOP", lane="TOP",
        individualPosition="TOP", win=True, kills=8, deaths=0, assists=4, goldEarned=10350,
        totalDamageDealtToChampions=17450, totalDamageTaken=13210, visionScore=33, summoner1Id=7, summoner2Id=21,
        allInPings=2, namePings="none", challenges={"a": 1.5}, perks={"statPerks": {"offense": 5005}},
    )
    return {**base, **kw}


def match(people=None, match_id="BR1_1", **info):
    base = dict(
        gameCreation=1712345678901, gameDuration=2145, gameMode="CLASSIC", gameVersion="15.23.1", mapId=11, queueId=420,
        participants=people if people is not None else [person()],
        teams=[dict(teamId=100, win=True, bans=[{"championId": 5}, {"championId": 0}, {"championId": -1}], objectives={"baron": {"first": True, "kills": 1}})],
    )
    return {"metadata": {"matchId": match_id}, "info": {**base, **info}}


def timeline(frames, ids=("p1", "p2"), match_id="BR1_1"):
    return {"metadata": {"matchId": match_id, "participants": list(ids)}, "info": {"frameInterval": 60000, "frames": frames}}


def frame(ts, people=None, events=()):
    return {"timestamp": ts, "participantFrames": people or {}, "events": list(events)}


def pf(gold=0, xp=0, cs=0, jungle=0, damage=0, position=None):
    out = {"totalGold": gold, "xp": xp, "minionsKilled": cs, "jungleMinionsKilled": jungle, "damageStats": {"totalDamageDoneToChampions": damage}}
    return {**out, "position": position} if position else out


@pytest.fixture
def read(spark):
    def run(schema, *docs):
        df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
        return documents.parse_json(df, schema)

    return run


@pytest.fixture
def parse(read):
    def run(*docs):
        return {r["puuid"]: r for r in timeline_parser.parse_timelines(read(schemas.TIMELINE, *docs)).collect()}

    return run


def test_match_and_teams(read):
    docs = read(schemas.MATCH, match(), match(match_id="BR1_2", teams=None))
    rows = {r["matchId"]: r for r in match_parser.match_rows(docs).collect()}
    assert rows["BR1_1"]["patch"] == "15.23" and rows["BR1_1"]["gameCreation"] == 1712345678901
    teams = match_parser.team_rows(docs).collect()
    assert [(t["matchId"], t["bans"]) for t in teams] == [("BR1_1", [5])]
    assert teams[0]["objectives_summary"]["baron"]["kills"] == 1


def test_missing_bans_are_an_empty_list(read):
    docs = read(schemas.MATCH, match(teams=[dict(teamId=200, win=False)]))
    assert match_parser.team_rows(docs).first()["bans"] == []


def test_participants(read):
    docs = read(
        schemas.MATCH,
        match([person(), person("p2", teamPosition="", individualPosition="JUNGLE", lane="", visionScore=None, deaths=3)]),
    )
    a, b = sorted(match_parser.participant_rows(docs).collect(), key=lambda r: r["pos"])
    assert a["kda"] == 12.0 and a["deaths"] == 0
    assert a["pings"] == {"allInPings": 2} and a["spells"] == [7, 21]
    assert json.loads(a["challenges"]) == {"a": 1.5} and a["runes"]["statPerks"]["offense"] == 5005
    assert (b["role"], b["lane"], b["visionScore"], b["kda"]) == ("JUNGLE", "JUNGLE", 0, 4.0)


def test_participant_map_reports_unknown_players(read):
    ids = match_parser.participant_map(read(schemas.TIMELINE, timeline([], ["p1", "ghost"])))
    people = match_parser.participant_rows(read(schemas.MATCH, match()))
    assert [tuple(r) for r in match_parser.unmatched_participants(ids, people).collect()] == [("BR1_1", 2, "ghost")]


def test_lane_pairs_last_of_a_lane_counts(read):
    docs = read(
        schemas.MATCH,
        match([
            person("a", championId=1, win=False), person("b", championId=2, win=False),
            person("c", championId=3, teamId=200, win=True), person("d", championId=4, teamId=200, individualPosition="JUNGLE"),
        ]),
    )
    slim = match_parser.slim_participants(docs)
    rows = match_parser.lane_pairs(slim).collect()
    assert [(r["position"], r["champion1Id"], r["champion2Id"], r["winnerId"]) for r in rows] == [("TOP", 2, 3, 3)]
    assert match_parser.match_outcomes(docs).first()["winningTeamId"] == 200
    nobody = read(schemas.MATCH, match([person(win=False)]))
    assert match_parser.match_outcomes(nobody).first()["winningTeamId"] == 0


def test_patch_list(spark):
    df = spark.createDataFrame([(["15.23.1", "15.22.1", "lol"],)], schemas.VERSIONS)
    assert [tuple(r) for r in match_parser.patch_list(df).orderBy("place").collect()] == [
        (0, "15.23", "15.23.1", True), (1, "15.22", "15.22.1", False), (2, "lol", "lol", False)
    ]


def test_no_frames_give_forty_zeros(parse):
    r = parse(timeline([]))["p1"]
    assert r["goldGraph"] == [0] * 40 and r["csGraph"] == [0] * 40 and r["itemTimeline"] == [] and r["skillOrder"] == []


def test_series(parse):
    frames = [
        frame(0, {"1": pf(500, 1, 2, 3, 4, {"x": 7, "y": 8})}),
        frame(60010, {"1": pf(600), "9": pf(1)}),
        frame(60500, {"1": pf(650)}),
        frame(180000, {"1": pf(900)}),
    ]
    out = parse(timeline(frames))
    # Last frame of a minute wins, minute 2 has none, the frame at minute 3 extends a series of length 3.
    assert out["p1"]["goldGraph"] == [500, 650, 0, 900]
    assert out["p1"]["csGraph"][0] == 5 and out["p1"]["xpGraph"][0] == 1 and out["p1"]["damageGraph"][0] == 4
    assert out["p2"]["goldGraph"] == [0, 0, 0]
    path = [(p["x"], p["y"], p["time"]) for p in out["p1"]["pathingSample"]]
    assert path == [(7, 8, 0), (None, None, 60010), (None, None, 60500), (None, None, 180000)]


def test_events(parse):
    kill = lambda ts, killer, victim, helpers=(): dict(
        type="CHAMPION_KILL", timestamp=ts, killerId=killer, victimId=victim, position={"x": ts, "y": 1}, assistingParticipantIds=list(helpers)
    )
    events = [
        kill(1, 1, 2), kill(2, 0, 1), kill(3, 2, 1, [1]),
        dict(type="WARD_PLACED", timestamp=4, creatorId=1, wardType="CONTROL_WARD"),
        dict(type="WARD_PLACED", timestamp=4, creatorId=0, wardType="CONTROL_WARD"),
        *[dict(type="SKILL_LEVEL_UP", timestamp=5, participantId=1, skillSlot=s) for s in (1, 4, 2, 3, 5)],
        dict(type="CHAMPION_SPECIAL_KILL", timestamp=6, killerId=1, killType="KILL_SOLO"),
        dict(type="CHAMPION_SPECIAL_KILL", timestamp=900000, killerId=1, killType="KILL_SOLO"),
    ]
    out = parse(timeline([frame(0, {}, events)]))
    spots = lambda ps: [p["timestamp"] for p in ps]
    assert spots(out["p1"]["killPositions"]) == [1] and spots(out["p1"]["deathPositions"]) == [2, 3]
    assert spots(out["p2"]["killPositions"]) == [3] and spots(out["p2"]["deathPositions"]) == [1]
    assert [tuple(w) for w in out["p1"]["wardPositions"]] == [(0, 0, 4, "CONTROL_WARD")] and out["p2"]["wardPositions"] == []
    assert "".join(out["p1"]["skillOrder"]) == "QRWE?"
    assert (out["p1"]["soloKills15"], out["p1"]["soloDeaths15"], out["p2"]["soloDeaths15"]) == (1, 1, 1)


def test_objectives(read):
    events = [
        dict(type="ELITE_MONSTER_KILL", timestamp=1, killerId=3, killerTeamId=100, monsterType="DRAGON", monsterSubType="FIRE"),
        dict(type="ELITE_MONSTER_KILL", timestamp=2, killerId=3, killerTeamId=200, monsterType="BARON_NASHOR", monsterSubType=""),
        dict(type="BUILDING_KILL", timestamp=3, killerId=0, teamId=100, buildingType="INHIBITOR_BUILDING", laneType="MID_LANE"),
        dict(type="BUILDING_KILL", timestamp=4, killerId=2, teamId=200, buildingType="TOWER_BUILDING", laneType="TOP_LANE"),
    ]
    docs = read(schemas.TIMELINE, timeline([frame(0, {}, events)]))
    rows = timeline_parser.objectives(docs).orderBy("place").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("DRAGON", "FIRE", 100, 1, 3), ("BARON_NASHOR", None, 200, 2, 3),
        ("INHIBITOR", "MID_LANE", 100, 3, 0), ("TOWER", "TOP_LANE", 200, 4, 2),
    ]


def undone(log):
    """The rule, plainly: an undo drops the latest living buy of its item and stays in the log."""
    out = []
    for kind, item in log:
        if kind == "UNDO":
            places = [i for i, e in enumerate(out) if e == ("BUY", item)]
            if places:
                del out[places[-1]]
        out.append((kind, item))
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["BUY", "SELL", "UNDO"]), st.integers(0, 3)), max_size=15), min_size=1, max_size=5))
def test_item_undo(spark, logs):
    rows = [(i, [(item, t, kind) for t, (kind, item) in enumerate(log)]) for i, log in enumerate(logs)]
    df = spark.createDataFrame(rows, f"id int, items {schemas.ITEMS}")
    got = df.select("id", timeline_parser.apply_undos(F.col("items")).alias("items")).orderBy("id").collect()
    assert [[(e["type"], e["itemId"]) for e in r["items"]] for r in got] == [undone(log) for log in logs]


def test_undo_in_a_document(parse):
    e = lambda t, ts, **kw: dict(type=t, timestamp=ts, participantId=1, **kw)
    events = [
        e("ITEM_PURCHASED", 1, itemId=7), e("ITEM_PURCHASED", 2, itemId=7), e("ITEM_UNDO", 3, beforeId=7, afterId=0),
        e("ITEM_UNDO", 4, beforeId=0, afterId=9), e("ITEM_SOLD", 5, itemId=7), e("ITEM_DESTROYED", 6, itemId=7),
    ]
    log = parse(timeline([frame(0, {}, events)]))["p1"]["itemTimeline"]
    assert [tuple(x) for x in log] == [(7, 1, "BUY"), (7, 3, "UNDO"), (0, 4, "UNDO"), (7, 5, "SELL")]


def test_event_classes(read):
    types = ["CHAMPION_KILL", "WARD_KILL", "ITEM_DESTROYED", "ELITE_MONSTER_KILL", "LEVEL_UP"]
    docs = read(schemas.TIMELINE, timeline([frame(0, {}, [dict(type=t, timestamp=1) for t in types])]))
    rows = {r["type"]: (r["isKill"], r["isWard"], r["isItem"], r["isElite"], r["isUsed"]) for r in timeline_parser.classified_events(docs).collect()}
    assert rows == {
        "CHAMPION_KILL": (True, False, False, False, True), "WARD_KILL": (False, True, False, False, True),
        "ITEM_DESTROYED": (False, False, True, False, False), "ELITE_MONSTER_KILL": (False, False, False, True, True),
        "LEVEL_UP": (False, False, False, False, False),
    }


def test_ingested_drops_matches_without_timeline_and_fills_missing_players(read):
    kill = dict(type="ELITE_MONSTER_KILL", timestamp=1, killerId=3, killerTeamId=100, monsterType="DRAGON", monsterSubType="")
    docs = reports.paired(
        read(schemas.MATCH, match([person("p1"), person("px")]), match(match_id="BR1_2")),
        read(schemas.TIMELINE, timeline([frame(60000, {"1": pf(10)}, [kill])])),
    )
    matches, teams, people = reports.ingested(docs)
    assert [r["matchId"] for r in matches.collect()] == ["BR1_1"]
    assert [len(t["objectives_timeline"]) for t in teams.collect()] == [1]
    rows = {r["puuid"]: r for r in people.collect()}
    assert rows["p1"]["goldGraph"] == [0, 10] and rows["px"]["goldGraph"] == [] and rows["px"]["itemTimeline"] == []


def test_paired_sides_are_dealt_by_match_into_parts(read):
    ids = [f"BR1_{i}" for i in range(60)]
    matches = read(schemas.MATCH, *[match(match_id=i) for i in ids])
    timelines = read(schemas.TIMELINE, *[timeline([frame(60000, {"1": pf(10)})], match_id=i) for i in ids])
    dealt = reports.paired(matches, timelines, 6)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, reports.paired(matches, timelines).collect()))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(matchId#" in plan and ", 6), REPARTITION_BY_NUM" in plan


def build_row(spark, items):
    df = spark.createDataFrame([("m", "p", 1, "Annie", items)], f"matchId string, puuid string, championId int, championName string, itemTimeline {schemas.ITEMS}")
    return details.match_builds(df).first()


def test_builds(spark):
    r = build_row(spark, [(1, 90000, "BUY"), (1, 100000, "SELL"), (2, 123456, "BUY"), (1, 130000, "BUY")])
    assert r["finalBuild"] == [1, 2] and r["itemTimeline"][0]["minute"] == 1.5 and r["itemTimeline"][2]["minute"] == 2.1
    assert build_row(spark, [(i, i, "BUY") for i in range(10)])["finalBuild"] == [4, 5, 6, 7, 8, 9]
    assert build_row(spark, None)["finalBuild"] == [] and build_row(spark, None)["itemTimeline"] == []


def test_match_events(spark):
    people = spark.createDataFrame(
        [("m", "p", 1, [(1, 2, 61000)], None, [(0, 0, 5, "CONTROL_WARD")]), ("m", "q", 2, None, [], None)],
        f"matchId string, puuid string, championId int, killPositions {schemas.POSITIONS}, deathPositions {schemas.POSITIONS}, wardPositions {schemas.WARDS}",
    )
    goals = [("DRAGON", None, None, 1, 3), ("TOWER", "TOP_LANE", 200, 2, 4)]
    teams = spark.createDataFrame([("m", 100, goals), ("m", 200, None)], f"matchId string, teamId int, objectives_timeline {schemas.OBJECTIVES}")
    assert sorted(r["teamId"] for r in details.objective_events(teams).collect()) == [100, 200]
    # Objectives of a match are there without team rows, and with a team that has none.
    matches = spark.createDataFrame([("m", goals), ("n", None)], f"matchId string, objectives {schemas.OBJECTIVES}")
    rows = details.match_events(people, matches).collect()
    assert sorted((r["kind"], r["minute"], r["teamId"] or 0) for r in rows) == [
        ("kill", 1, 0), ("objective", 0, 0), ("objective", 0, 200), ("ward", 0, 0)
    ]
    assert details.position_events(people, "killPositions").first()["minute"] == 1
    assert details.ward_events(people).first()["wardType"] == "CONTROL_WARD"


def test_match_detail(read):
    docs = read(schemas.MATCH, match([person("b"), person("a")]))
    stored = details.stored_detail(match_parser.match_rows(docs), match_parser.team_rows(docs), match_parser.participant_rows(docs))
    nested = details.match_detail(docs)
    r = documents.longs_as_text(nested).first()
    assert r["gameCreation"] == "1712345678901" and [p["puuid"] for p in r["participants"]] == ["b", "a"] and len(r["teams"]) == 1
    # Inside the row as from the tables, without an exchange.
    assert stored.select(*nested.columns).first() == nested.first()
    assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()


def test_readers(spark, tmp_path):
    (tmp_path / "champions.json").write_text(json.dumps({"type": "champion", "version": "1", "data": {"Annie": {"version": "1", "id": "Annie", "key": "1", "name": "Annie", "title": "t"}}}, indent=1))
    assert documents.read_champions_file(spark, str(tmp_path / "champions.json")).first()["championId"] == 1
    (tmp_path / "league.json").write_text(json.dumps({"tier": "MASTER", "entries": [{"puuid": "a", "leaguePoints": 5}]}))
    assert tuple(documents.read_league(spark, str(tmp_path / "league.json")).first())[:2] == ("a", "MASTER")
    (tmp_path / "ids.json").write_text(json.dumps({"puuid": "a", "ids": ["m1", "m2", "m3"]}))
    lists = documents.read_match_ids(spark, str(tmp_path / "ids.json"))
    assert [r["matchId"] for r in documents.take_match_ids(lists, count=2, start=1).collect()] == ["m2", "m3"]
    (tmp_path / "m.json").write_text(json.dumps(match()))
    assert match_parser.match_rows(documents.read_matches(spark, str(tmp_path / "m.json"))).first()["queueId"] == 420
    (tmp_path / "t.json").write_text(json.dumps(timeline([])))
    assert documents.read_timelines(spark, str(tmp_path / "t.json")).count() == 1
    out = str(tmp_path / "out")
    documents.write_json(spark.sql("select 1L as a, map('k', 2L) as b, array(3L) as c, struct(4L as x, 5 as y) as d"), out)
    assert json.loads(spark.read.text(out).first()[0]) == {"a": "1", "b": {"k": "2"}, "c": ["3"], "d": {"x": "4", "y": 5}}
