import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import activity, audit, catalog, champion_stats, collection, compare, details, gold, history, lanes, player_stats, tiers
from matchlake.plans import reports
from matchlake.sources import star


def graphs(spark, *rows):
    return spark.createDataFrame([(m, t, g) for m, t, g in rows], "matchId string, teamId int, goldGraph array<int>")


def diffs(spark, values, match_id="m"):
    return spark.createDataFrame([(match_id, i, v) for i, v in enumerate(values)], "matchId string, minute int, difference long")


def test_gold_timeline(spark):
    df = graphs(spark, ("m", 100, [1, 2, 3]), ("m", 200, [5]), ("m", 100, [10, 10]), ("n", 100, []), ("o", 200, list(range(40))))
    rows = gold.gold_timeline(df).orderBy("matchId", "minute").collect()
    m = [tuple(r)[1:] for r in rows if r["matchId"] == "m"]
    assert m == [(0, 11, 5, 6), (1, 12, 0, 12), (2, 3, 0, 3)]
    assert [r["redTeam"] for r in rows if r["matchId"] == "o"] == list(range(40))
    assert not [r for r in rows if r["matchId"] == "n"]


@pytest.mark.parametrize(
    "values, winner, lead, throw",
    [
        ([100, -500, 500], "blueTeam", (1, "redTeam", 500), None),
        ([0, 0], "redTeam", (0, "redTeam", 0), None),
        ([0, 3000, 0], "redTeam", (1, "blueTeam", 3000), None),
        ([1000, 2000, -2500, 5000], "blueTeam", (3, "blueTeam", 5000), (2, 2000, -2500, 4500)),
    ],
)
def test_gold_insights(spark, values, winner, lead, throw):
    r = gold.gold_insights(diffs(spark, values)).first()
    assert r["winner"] == winner
    assert (r["maxAdvantageMinute"], r["maxAdvantageTeam"], r["maxAdvantage"]) == lead
    got = (r["throwMinute"], r["throwBefore"], r["throwAfter"], r["throwSwing"])
    assert got == (throw or (None,) * 4)


def test_match_without_gold_goes_to_red(spark):
    m = spark.createDataFrame([("x",)], "matchId string")
    r = gold.gold_insights(diffs(spark, [1]), m).first()
    assert r["winner"] == "redTeam" and r["maxAdvantage"] is None


PLAYER = "matchId string, pos int, puuid string, championId int, teamId int, role string, win boolean, kills int, deaths int, assists int, kda double, goldEarned int, totalDamage int, damageTaken int, visionScore int, goldGraph array<int>, xpGraph array<int>, csGraph array<int>, damageGraph array<int>"
MATCH = "matchId string, patch string, queueId int, gameVersion string, gameCreation long, gameDuration int"


def player(match_id="m", pos=0, puuid="a", champion=1, team=100, role="TOP", win=True, kills=5, deaths=2, assists=5, gold_=9000, damage=15000, taken=12000, vision=30, cs=(0, 60, 150), n=0):
    long = [i * 10 + n for i in range(20)] if n else []
    return (match_id, pos, puuid, champion, team, role, win, kills, deaths, assists, (kills + assists) / max(deaths, 1), gold_, damage, taken, vision, long, long, list(cs) if not n else long, long)


def players_df(spark, *rows):
    return spark.createDataFrame(list(rows), PLAYER)


def match_df(spark, *rows):
    return spark.createDataFrame(list(rows) or [("m", "15.1", 420, "15.1.9", 1000, 1800)], MATCH)


def test_performance(spark):
    df = players_df(
        spark, player(), player(pos=1, puuid="b", team=200, gold_=6000, damage=12000, vision=15, taken=15000, cs=(0,)),
        player(pos=2, puuid="c", team=200, role="JUNGLE", cs=()), player(pos=3, puuid="d", team=200, damage=1),
    )
    r = {x["puuid"]: x for x in details.match_performance(df, match_df(spark)).collect()}
    a = r["a"]
    assert (a["dpm"], a["gpm"], a["cspm"], a["visionScorePerMin"], a["damageTakenPerMin"]) == (500.0, 300.0, 5.0, 1.0, 400.0)
    assert a["opponentPuuid"] == "b" and (a["dpmAdvantage"], a["dpmAdvantagePercent"]) == (100.0, 25.0)
    assert (a["cspmAdvantage"], a["cspmAdvantagePercent"]) == (5.0, 0.0)  # nothing to divide by
    assert (a["visionAdvantage"], a["survivability"]) == (0.5, 100.0)
    assert r["c"]["cspm"] == 0.0 and r["c"]["opponentPuuid"] is None and r["c"]["dpmAdvantage"] is None
    assert r["d"]["opponentPuuid"] == "a"


def test_opponent_against_brute_force(spark):
    rng = random.Random(7)
    rows = [
        player(f"m{m}", pos, f"p{pos}", team=rng.choice([100, 200]), role=rng.choice(["TOP", "JUNGLE", ""]))
        for m in range(30) for pos in range(10)
    ]
    got = {(r["matchId"], r["pos"]): r["opponent"] and r["opponent"]["pos"] for r in lanes.lane_opponents(players_df(spark, *rows), ["championId"]).collect()}
    for r in rows:
        rivals = [o for o in rows if o[0] == r[0] and o[5] == r[5] and o[4] != r[4]]
        assert got[(r[0], r[1])] == (rivals[0][1] if rivals else None)


def test_player_aggregates(spark):
    df = players_df(
        spark,
        player("m", 0, "a", n=5), player("m", 1, "b", team=200, win=False, n=3),
        player("n", 0, "a", role="JUNGLE", win=False, kills=0, assists=3, deaths=0, n=1),
        player("z", 0, "a", champion=2, role="JUNGLE"),
    )
    m = match_df(
        spark, ("m", "15.1", 420, "15.1.9", 10, 1800), ("n", "15.2", 420, "15.2.1", 30, 1800), ("z", "15.2", 440, "15.2.1", 20, 0)
    )
    partials = player_stats.player_partials_of(df, m)
    stats = {(r["puuid"], r["patch"], r["queueId"]): r for r in player_stats.player_stats(partials).collect()}
    life = stats[("a", "ALL", 420)]
    assert (life["gamesPlayed"], life["wins"], life["losses"], life["winRate"], life["avgKda"]) == (2, 1, 1, 50.0, 4.0)
    assert stats[("a", "15.1", 420)]["gamesPlayed"] == 1
    # No duration: no rates, but the game counts.
    zero = stats[("a", "ALL", 440)]
    assert zero["gamesPlayed"] == 1 and zero["avgDpm"] == 0.0
    champs = {(r["puuid"], r["championId"], r["patch"], r["queueId"]): r for r in player_stats.player_champion_stats(partials).collect()}
    c = champs[("a", 1, "ALL", 420)]
    # One of two games had a lane opponent; only that one counts.
    assert (c["avgCsd15"], c["avgGd15"], c["avgXpd15"], c["lastPlayedAt"]) == (2.0, 2.0, 2.0, 30)
    roles = {(r["puuid"], r["patch"], r["queueId"]): r["roleDistribution"] for r in player_stats.role_distribution(partials).collect()}
    assert roles[("a", "ALL", 420)] == {"JUNGLE": 1, "TOP": 1}
    top = player_stats.top_champions(partials).where("puuid = 'a' and patch = 'ALL'").collect()
    assert {(r["queueId"], r["championId"], r["games"]) for r in top} == {(420, 1, 2), (440, 2, 1)}
    cat = spark.createDataFrame([(1, "Annie", "Annie", "t", "15.1.1")], "championId int, id string, name string, title string, version string")
    mids = reports.player_champions(partials, cat, role="JUNGLE").collect()
    assert [(r["puuid"], r["championName"]) for r in mids] == [("a", "Annie")]
    assert reports.player_champions(partials, cat, role="MID").count() == 0
    for limit in (0, 51):
        with pytest.raises(ValueError):
            reports.player_champions(partials, cat, limit=limit)
    assert catalog.enrich(spark.sql("select 9 as championId"), cat).first()["championName"] == "Champion 9"
    assert catalog.enrich(spark.sql("select 9 as championId"), cat, keep_unknown=False).count() == 0


def test_champion_stats(spark):
    df = players_df(spark, player("m", 0, "a"), player("m", 1, "b", win=False, kills=0, assists=0), player("n", 0, "a", champion=2))
    m = match_df(spark, ("m", "15.1", 420, "15.1.9", 10, 1800), ("n", "15.1", 420, "15.1.9", 10, 1800))
    teams = spark.createDataFrame([("m", [1, 1]), ("m", [1]), ("n", [7])], "matchId string, bans array<int>")
    rows = {r["championId"]: r for r in champion_stats.champion_stats_of(df, m, teams).collect()}
    assert set(rows) == {1, 2}
    a = rows[1]
    assert (a["gamesPlayed"], a["winRate"], a["kda"], a["dpm"], a["banRate"], a["pickRate"]) == (2, 50.0, 2.5, 500.0, 50.0, 100.0)
    assert rows[2]["banRate"] == 0.0
    totals = {r["championId"]: r for r in champion_stats.champion_totals(df, m, teams).collect()}
    assert (totals[1]["totalBans"], totals[1]["totalKills"], totals[1]["totalCs"]) == (3, 5, 300)


def stat(champion, games, win_rate=50.0, patch="15.2", queue=420, ban=10.0):
    return (champion, patch, queue, games, int(games / 2), games - int(games / 2), win_rate, 3.0, 600.0, 400.0, 7.0, ban, 10.0)


STATS = "championId int, patch string, queueId int, gamesPlayed long, wins long, losses long, winRate double, kda double, dpm double, gpm double, cspm double, banRate double, pickRate double"
CATALOG = "championId int, id string, name string, title string, version string"


def test_tier_list(spark):
    df = spark.createDataFrame(
        [stat(1, 100, 52.0), stat(2, 100, 54.0), stat(3, 10, 99.0), stat(9, 100, 60.0), stat(1, 100, 40.0, "15.1"), stat(2, 40, 1.0, "15.1")], STATS
    )
    cat = spark.createDataFrame([(i, n.replace(" ", ""), n, "t", "15.1.1") for i, n in ((1, "Annie"), (2, "Lee Sin"), (3, "Zed"))], CATALOG)
    rows = {r["championId"]: r for r in reports.tier_list(df, cat, "15.2").collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[2]["rank"], rows[1]["rank"], rows[3]["rank"]) == (1, 2, None)
    assert rows[3]["tier"] == "Dados Insuficientes" and rows[3]["score"] == 0.0
    page = reports.tier_list_page(df, cat, "15.2", sort_by="rank", order="asc", limit=2).collect()
    assert [r["championId"] for r in page] == [3, 2] and page[0]["total"] == 3
    assert [r["championId"] for r in reports.tier_list_page(df, cat, "15.2", limit=2, page=2).collect()] == [1]
    # The detail's rank also counts champions the catalog does not know.
    assert reports.champion_detail(df, cat, "LEE sin", "15.2").first()["rank"] == 2
    with pytest.raises(ValueError):
        tiers.sort_page(df, "name")
    with pytest.raises(ValueError):
        tiers.sort_page(df, limit=201)


def test_processed_matches(spark):
    m = match_df(spark)
    assert tuple(reports.processed_matches(m).first()) == (1, None, None)
    assert tuple(reports.processed_matches(m, "15.9").first()) == (0, "15.9", "Não há dados para o patch 15.9")


def games_df(spark, rows):
    return spark.createDataFrame(rows, "puuid string, gameCreation long, win boolean")


def test_activity(spark):
    sunday = 1704067200000 - 21 * 3600 * 1000  # Sunday 00:00 local
    hour = 3600 * 1000
    rows = [("a", sunday, i < 3) for i in range(5)] + [("a", sunday + hour, True)] * 5 + [("a", sunday + 24 * hour, False)] * 4
    rows += [("b", sunday + 50 * hour, True)]
    cells = activity.activity_cells(games_df(spark, rows))
    grid = activity.heatmap(cells)
    assert grid.count() == 336 and grid.agg(F.sum("games")).first()[0] == len(rows)
    assert grid.where("puuid = 'a' and dayOfWeek = 0 and hour = 0").first()["winRate"] == 60.0
    r = {x["puuid"]: x for x in activity.activity_insights(cells).collect()}
    a = r["a"]
    assert (a["mostActiveDay"], a["mostActiveDayGames"], a["mostActiveHour"], a["mostActiveHourGames"]) == ("Sunday", 10, 0, 5)
    assert (a["peakWinRate"], a["peakWinRateTime"], a["worstWinRate"], a["worstWinRateTime"]) == (100.0, "Sunday 1h", 60.0, "Sunday 0h")
    b = r["b"]
    assert (b["mostActiveDay"], b["peakWinRate"], b["peakWinRateTime"], b["worstWinRateTime"]) == ("Tuesday", 0.0, "N/A", "N/A")


def history_games(spark, n=30):
    df = players_df(spark, *[player(f"m{i:02}", 0, "a", champion=i % 3, role=("TOP", "MIDDLE")[i % 2], win=i % 4 == 0, kills=i % 7) for i in range(n)])
    m = match_df(spark, *[(f"m{i:02}", "15.1", 420 if i % 5 else 440, "15.1.9", 1000 + i // 2, 1800) for i in range(n)])
    return df, m


@pytest.mark.parametrize(
    "filters, keep",
    [
        ({}, lambda i: i % 5),
        ({"queue_id": 440}, lambda i: i % 5 == 0),
        ({"champion_id": 2}, lambda i: i % 5 and i % 3 == 2),
        ({"role": "MID"}, lambda i: i % 5 and i % 2),
        ({"result": "win"}, lambda i: i % 5 and i % 4 == 0),
        ({"result": "loss"}, lambda i: i % 5 and i % 4),
        ({"start_ms": 1003, "end_ms": 1005}, lambda i: i % 5 and 3 <= i // 2 <= 5),
        ({"puuid": "b"}, lambda i: False),
    ],
)
def test_history_filters(spark, filters, keep):
    rows = reports.player_games(*history_games(spark), **filters).collect()
    assert sorted(r["matchId"] for r in rows) == [f"m{i:02}" for i in range(30) if keep(i)]


@pytest.mark.parametrize("sort", ["recent", "kda", "kills", "damage"])
def test_history_pages_by_offset_and_by_cursor(spark, sort):
    rows = reports.player_games(*history_games(spark))
    column = history.SORTS[sort]
    wanted = [r["matchId"] for r in sorted(rows.collect(), key=lambda r: (-r[column], r["matchId"]))]
    by_page = [history.history_page(rows, p, 10, sort).orderBy("place").collect() for p in (1, 2, 3)]
    assert [r["matchId"] for page in by_page for r in page] == wanted
    assert [page[0]["hasMore"] for page in by_page] == [True, True, False]
    assert by_page[0][0]["nextCursor"] == wanted[9] and by_page[2][0]["nextCursor"] is None
    cursor, seen = "unknown", []
    while cursor:
        cursors = spark.createDataFrame([("a", cursor)], "puuid string, cursor string")
        page = history.history_after(rows, cursors, 10, sort).orderBy("place").collect()
        seen += [r["matchId"] for r in page]
        cursor = page[0]["nextCursor"]
    assert seen == wanted
    with pytest.raises(ValueError):
        history.history_page(rows, limit=51)


def test_average_timeline(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("a", [2, 2, 9]), ("a", [])], "puuid string, csGraph array<int>")
    rows = compare.average_timeline(df, "csGraph").orderBy("minute").collect()
    assert [(r["minute"], r["value"]) for r in rows] == [(0, 2), (1, 2), (2, 9)]


def test_all_games_enter_timelines_unless_a_sample_is_asked_for(spark):
    df = spark.createDataFrame([("a", f"m{i:03}", i) for i in range(150)], "puuid string, matchId string, gameCreation long")
    assert compare.timeline_games(df).agg(F.min("gameCreation"), F.count("*")).first() == (0, 150)
    assert compare.timeline_games(df, 100).agg(F.min("gameCreation"), F.count("*")).first() == (50, 100)


def compared(spark, hero, villain, laning=(0.0, 0.0)):
    """(winRate, kda, cspm, dpm, vision) of both."""
    stats = spark.createDataFrame(
        [("h", 10, hero[0], hero[1], hero[2], hero[3], 400.0, hero[4], laning[0], 0.0, 0.0, 1, 0),
         ("v", 10, villain[0], villain[1], villain[2], villain[3], 400.0, villain[4], laning[1], 0.0, 0.0, 0, 2)],
        "puuid string, gamesPlayed int, winRate double, avgKda double, avgCspm double, avgDpm double, avgGpm double, avgVisionScore double, avgCsd15 double, avgGd15 double, avgXpd15 double, soloKills15 long, soloDeaths15 long",
    )
    users = spark.createDataFrame([("h", "H"), ("v", "V")], "puuid string, gameName string")
    pairs = spark.createDataFrame([("h", "v"), ("h", "nobody")], "hero string, villain string")
    rows = compare.with_insights(compare.compare_stats(pairs, users, stats, laning=True)).collect()
    assert len(rows) == 1 and (rows[0]["heroSoloKills15"], rows[0]["villainSoloDeaths15"]) == (1, 2)
    return rows[0]["winner"], rows[0]["advantages"], rows[0]["recommendations"]


def test_insights(spark):
    base = (50.0, 3.0, 7.0, 500.0, 20.0)
    assert compared(spark, base, base) == ("hero", [], [])
    assert compared(spark, (50.0, 3.0, 8.0, 500.0, 20.0), base) == ("hero", ["Herói tem 14.3% mais CS/min"], [])
    assert compared(spark, base, (50.0, 3.0, 8.0, 500.0, 20.0)) == (
        "hero", ["Vilão tem 12.5% mais CS/min"], ["Herói deve melhorar farm e controle de wave"])
    assert compared(spark, base, base, (5.0, 0.0))[1] == ["Herói tem +5 CSD@15"]
    assert compared(spark, base, base, (0.0, 3.0))[1] == []
    assert compared(spark, (40.0, 3.0, 7.0, 500.0, 30.0), base)[:2] == ("villain", ["Herói tem +10 vision score"])
    assert compared(spark, base, (50.0, 3.0, 7.0, 600.0, 20.0))[2] == ["Herói deve participar mais de teamfights e buscar trades"]
    assert compared(spark, (45.0, 4.0, 7.0, 500.0, 20.0), base)[2] == [compare.TEXTS["convert"]]
    assert compared(spark, (55.0, 2.0, 7.0, 500.0, 20.0), base)[1] == [compare.TEXTS["better_kda"]]
    assert compared(spark, (50.0, 3.0, 0.0, 0.0, 20.0), base) == ("hero", [], [])


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "puuid string, matchId string")


def test_collection(spark):
    stored = spark.createDataFrame([("m1",), ("m2",)], "matchId string")
    a = ids(spark, ("a", "m1"), ("a", "m3"), ("b", "m3"), ("c", "m2"))
    people = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "puuid string")
    assert tuple(collection.collection_counts(people, a, stored).first()) == (4, 4, 1, 3)
    assert collection.new_ids(a, stored).count() == 2 and collection.existing_ids(a, stored).count() == 2
    work = collection.work_list(ids(spark, ("a", "m3")), ids(spark, ("a", "m3"), ("a", "m4")), ids(spark, ("a", "m5"), ("b", "m4")))
    assert sorted(map(tuple, work.collect())) == [("m3", 10), ("m4", 5), ("m5", 1)]
    sync = {r["puuid"]: (r["status"], r["matchesEnqueued"], r["message"]) for r in collection.start_sync(people, a, stored).collect()}
    assert sync["a"] == ("SYNCING", 1, "Deep sync started: 1 matches enqueued")
    assert sync["c"] == ("DONE", 0, "All matches already in database")
    assert sync["d"] == ("DONE", 0, "No ranked matches found in Riot API")
    asked = spark.createDataFrame([("a", 100), ("c", 100), ("b", -5000)], "puuid string, startedAt long")
    state = {r["puuid"]: (r["status"], r["matchesProcessed"], r["matchesTotal"], r["startedAt"]) for r in collection.sync_status(asked, a, stored, 200).collect()}
    assert state == {"a": ("SYNCING", 1, 2, 100), "c": ("DONE", 1, 1, 100), "b": ("IDLE", 0, 0, None)}
    update = {r["puuid"]: (r["status"], r["message"]) for r in collection.update_status(people, a, stored).collect()}
    assert update["a"] == ("UPDATING", "Processing matches: 1/2") and update["d"] == ("IDLE", "All matches processed")


def test_leagues_and_ranked_entries(spark):
    entries = lambda *p: spark.createDataFrame([(x,) for x in p], "puuid string")
    assert collection.high_elo_players([entries("a", "b"), entries("b"), entries("c")]).count() == 3
    e = lambda q, t, lp: (q, t, "I", lp, 0, 0)
    df = spark.createDataFrame(
        [("a", [e("RANKED_FLEX_SR", "IRON", 1), e("RANKED_SOLO_5x5", "GOLD", 0), e("RANKED_SOLO_5x5", "X", 2)]), ("b", [])],
        "puuid string, entries array<struct<queueType: string, tier: string, rank: string, leaguePoints: int, wins: int, losses: int>>",
    )
    rows = {r["puuid"]: (r["tier"], r["leaguePoints"], r["rankedWins"]) for r in collection.ranked_solo(df).collect()}
    assert rows == {"a": ("GOLD", 0, 0), "b": (None, None, None)}


def test_upsert_keeps_region_and_creation(spark):
    names = ["puuid", "lastUpdated", "region", *collection.PROFILE]
    rows = [("a", t, r, f"n{t}", "BR1", 1, 2, "s", "GOLD", "I", t, 1, 1) for t, r in ((5, "br1"), (9, "kr"), (7, "euw"))]
    r = collection.upsert_players(spark.createDataFrame(rows, names)).first()
    assert (r["gameName"], r["region"], r["lastUpdated"], r["createdAt"], r["leaguePoints"]) == ("n9", "br1", 9, 5, 9)


def test_request_window_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["k", "l", None]), rng.randrange(0, 30000)) for _ in range(400)] + [("k", 120), ("k", 120), ("k", 10119), ("k", 10120)]
    got = audit.request_window(spark.createDataFrame(rows, "key string, ts_ms long"), 10, 20)
    by_key = {}
    for k, t in set(rows):
        by_key.setdefault(k, []).append(t)
    wanted = sorted((t, n, n < 20) for ts in by_key.values() for t in ts for n in [sum(t - 10000 < o <= t for o in ts)])
    assert sorted((r["ts_ms"], r["requestsInWindow"], r["canProceed"]) for r in got.collect()) == wanted


def test_stats_and_series(spark):
    """Sums and series of one pass: each game counts once however many minutes it has, one without a series too."""
    row = lambda p, cs, gold, win, vision: (p, cs, gold, win, 2.0, 100.0, 300.0, 5.0, vision, True, 2, 10, None, 7)
    games = spark.createDataFrame(
        [row("a", [1, 2, 4], [10, 20], True, 30), row("a", [2, 3], [11, 21, 31], False, 10), row("b", [], [], True, 5)],
        "puuid string, csGraph array<int>, goldGraph array<int>, win boolean, kda double, dpm double, gpm double, cspm double, visionScore int, "
        "hasOpponent boolean, csd15 long, gd15 long, xpd15 long, gameCreation long",
    )
    got = {r["puuid"]: r for r in compare.stats_and_series(games, {"csGraph": "cs", "goldGraph": "gold"}).collect()}
    assert (got["a"]["cs"], got["a"]["gold"]) == ([2, 3, 4], [11, 21, 31]) and (got["b"]["cs"], got["b"]["gold"]) == ([], [])
    shown = lambda r: (r["gamesPlayed"], r["wins"], r["winRate"], r["avgVisionScore"], r["avgCsd15"], r["avgXpd15"], r["avgDpm"])
    assert shown(got["a"]) == (2, 1, 50.0, 20.0, 2.0, 0.0, 100.0) and shown(got["b"]) == (1, 1, 100.0, 5.0, 2.0, 0.0, 100.0)


def test_work_is_ranked_once_and_numbered_over_ranges(spark):
    played = spark.createDataFrame(
        [("a", f"m{i:02}", 1000 - i, 420 if i % 3 == 0 else 440) for i in range(40)] + [("b", "m00", 1000, 420), ("b", "m00", 1000, 420), ("b", "x", 1, None)],
        "puuid string, matchId string, gameCreation long, queueId int",
    )
    stored = spark.createDataFrame([("m01",), ("other",)], "matchId string")
    got = collection.ranked_work(played, stored, user=2, sync=5, background=9)
    wanted = collection.work_list(
        *[collection.new_ids(collection.recent_match_ids(played, **kw), stored) for kw in (dict(count=2), dict(count=5, queue_id=420), dict(count=9))]
    )
    assert sorted((r["matchId"], r["priority"]) for r in got.collect()) == sorted((r["matchId"], r["priority"]) for r in wanted.collect())
    placed = sorted(collection.in_order(got).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in placed] == list(range(len(placed)))
    assert [(r["matchId"]) for r in placed] == [r["matchId"] for r in sorted(got.collect(), key=lambda r: (-r["priority"], -r["gameCreation"], r["matchId"]))]
    assert collection.in_order(got.limit(0)).count() == 0


def test_average_timeline_moves_a_series_once(spark):
    games = spark.createDataFrame([("a", [1, 2]), ("a", [4]), ("b", [None, 5]), ("c", []), ("d", None), (None, [7])], "puuid string, s array<int>")
    out = compare.average_timeline(games, "s")
    # The shuffle lies below the unpacking, and nothing moves after it.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    physical = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression") and "Exchange" in physical
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1
    assert {tuple(r) for r in out.collect()} == {("a", 0, 3), ("a", 1, 2), ("b", 0, None), ("b", 1, 5), (None, 0, 7)}


def test_participants_move_before_their_series_are_made(spark, tmp_path):
    """One shuffle of lines by match serves both the grouping by minute and the windows over it, however many splits the table has."""
    rows = spark.range(0, 400, numPartitions=16).selectExpr(
        "id DIV 4 AS l_orderkey", "id % 37 AS l_partkey", "id % 11 AS l_suppkey", "1 + id % 4 AS l_linenumber",
        "CAST(id % 50 AS double) AS l_quantity", "CAST(100 + id AS double) AS l_extendedprice", "if(id % 2 = 0, 'O', 'F') AS l_linestatus",
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = gold.gold_insights(gold.gold_timeline(star.participants(spark, str(tmp_path))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan.split("Exchange hashpartitioning")[1]
    assert out.count() == 100
