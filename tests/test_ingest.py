import json
import random

import pytest

from matchlake.operators import player_stats
from matchlake.plans import registry
from matchlake.sources import star
from matchlake.sources.store import MatchStore
from matchlake.streaming import ingest

LANES = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]


def record(i, timeline=True):
    rng = random.Random(i)
    people = [
        dict(
            puuid=f"p{(i + n * 3) % 13}", championId=rng.randrange(1, 6), teamId=100 if n < 5 else 200, teamPosition=LANES[n % 5],
            win=(n < 5) == (i % 2 == 0), kills=rng.randrange(9), deaths=rng.randrange(5), assists=rng.randrange(9),
            goldEarned=rng.randrange(9000), totalDamageDealtToChampions=rng.randrange(30000), visionScore=rng.randrange(50),
        )
        for n in range(10)
    ]
    ids = [p["puuid"] for p in people]
    teams = [dict(teamId=t, win=(t == 100) == (i % 2 == 0), bans=[{"championId": rng.randrange(0, 6)}]) for t in (100, 200)]
    info = dict(gameCreation=1700000000000 + i * 1000, gameDuration=1500 + i, queueId=420, gameVersion=f"15.{1 + i % 2}.1", participants=people, teams=teams)
    frames = [
        dict(timestamp=m * 60000, events=[], participantFrames={str(n + 1): dict(totalGold=m * rng.randrange(300), xp=m, minionsKilled=m * n, jungleMinionsKilled=0) for n in range(10)})
        for m in range(18)
    ]
    meta = {"matchId": f"BR1_{i}", "participants": ids}
    out = {"match": {"metadata": meta, "info": info}}
    if timeline:
        out["timeline"] = {"metadata": meta, "info": {"frames": frames}}
    return out


def frame(spark, records):
    rows = [(json.dumps(r["match"]), json.dumps(r["timeline"]) if "timeline" in r else None) for r in records]
    return spark.createDataFrame(rows, ingest.LANDED)


def state(store):
    champs = sorted(map(tuple, store.champion_stats().collect()), key=str)
    people = sorted(map(tuple, player_stats.player_champion_stats(store.player_partials()).collect()), key=str)
    return champs, people


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    store = MatchStore(spark, str(tmp_path_factory.mktemp("whole"))).create()
    ingest.ingest(frame(spark, [record(i) for i in range(12)]), store, "batch", 0)
    return store


def test_any_split_gives_the_same_aggregates(spark, whole, tmp_path):
    store = MatchStore(spark, str(tmp_path), fanout=2).create()
    for batch, part in enumerate(([0, 1, 2], [1, 3, 4, 4, 5, 6], [7, 8, 9, 10, 11, 0])):
        ingest.ingest(frame(spark, [record(i) for i in part]), store, "batch", batch)
    assert state(store) == state(whole)
    assert store.table("matches").count() == 12 and store.table("participants").count() == 120 and store.table("teams").count() == 24
    last, runs = store.state()
    assert last == 2 and len([r for r in runs if r.table == "player_partials"]) == 2  # three batches, two of them merged


def test_committed_batches_are_skipped_and_broken_ones_rewritten(spark, whole, tmp_path):
    store = MatchStore(spark, str(tmp_path)).create()
    ingest.ingest(frame(spark, [record(i) for i in range(6)]), store, "batch", 0)
    ingest.ingest(frame(spark, [record(99)]), store, "batch", 0)
    assert store.table("matches").count() == 6

    class Broken(MatchStore):
        def _commit(self, *args):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ingest.ingest(frame(spark, [record(i) for i in range(6, 12)]), Broken(spark, str(tmp_path)), "batch", 1)
    assert store.table("matches").count() == 6  # written, but not visible
    ingest.ingest(frame(spark, [record(i) for i in range(6, 12)]), store, "batch", 1)
    assert state(store) == state(whole)


def test_unusable_records_fall_out(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path)).create()
    records = frame(spark, [record(0), record(1, timeline=False)]).union(spark.createDataFrame([("{broken", "{}"), (None, None)], ingest.LANDED))
    ingest.ingest(records, store, "batch", 0)
    assert [r["matchId"] for r in store.table("matches").collect()] == ["BR1_0"]
    assert [(r["reason"], r["match"]) for r in store.table("rejected").collect()] == [("match without an id", "{broken")]
    ingest.ingest(records.limit(0), store, "batch", 1)
    assert store.state()[0] == 1 and store.table("matches").count() == 1


def test_stream_equals_batch(spark, whole, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store")).create()
    landing = tmp_path / "landing"
    landing.mkdir()
    for wave in (range(0, 5), range(3, 12)):
        for i in wave:
            (landing / f"{wave.start}-{i}.json").write_text(json.dumps(record(i)))
        ingest.run_available(spark, str(landing), store, files_per_trigger=6)
    assert state(store) == state(whole)
    assert store.state()[0] >= 2


def test_players_table(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path)).create()
    row = lambda t, region: spark.sql(
        f"select 'a' puuid, 'n{t}' gameName, 'BR1' tagLine, '{region}' region, 1 profileIconId, 1 summonerLevel, 's' summonerId, "
        f"'GOLD' tier, 'I' rank, 0 leaguePoints, 1 rankedWins, 1 rankedLosses, timestamp_seconds({t}) lastUpdated"
    )
    store.save_players(row(10, "br1"))
    store.save_players(row(20, "kr"))
    r = store.players().first()
    assert (r["gameName"], r["region"]) == ("n20", "br1")


def test_sources_do_not_share_numbers(spark, whole, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store")).create()
    ingest.ingest(frame(spark, [record(i) for i in range(6)]), store, "backfill", 0)
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(6, 12):
        (landing / f"{i}.json").write_text(json.dumps(record(i)))
    ingest.run_available(spark, str(landing), store)
    assert state(store) == state(whole)


def test_stream_with_a_lost_checkpoint_stores_nothing_twice(spark, whole, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store")).create()
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(12):
        (landing / f"{i}.json").write_text(json.dumps(record(i)))
        if i == 5:
            ingest.run_available(spark, str(landing), store)
            (tmp_path / "store" / "_stream").rename(tmp_path / "lost")
    ingest.run_available(spark, str(landing), store)
    assert state(store) == state(whole)


def test_changed_and_missing_creation_times_are_the_same_match(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path)).create()
    other, none = record(1), record(1)
    other["match"]["info"]["gameCreation"] += 999_999
    del none["match"]["info"]["gameCreation"]
    ingest.ingest(frame(spark, [none, other, record(1)]), store, "batch", 0)
    ingest.ingest(frame(spark, [other, none]), store, "batch", 1)
    assert [r["gameCreation"] for r in store.table("matches").collect()] == [record(1)["match"]["info"]["gameCreation"]]


def test_shared_folder_is_asked_for_off_local_masters():
    from types import SimpleNamespace

    from matchlake.session import shared_dir

    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(there)


def events(spark, path, n):
    """An events table of n blocks, a null id and a repeated row."""
    ids = [(i,) for i in range(n * 60)] + [(5,), (None,)]
    rows = spark.createDataFrame(ids, "event_id bigint").selectExpr(
        "event_id", "coalesce(event_id, 0) % 17 AS user_id", "elt(1 + coalesce(event_id, 0) % 4, 'click', 'view', 'purchase', 'signup') AS event_type",
        "event_id * 1.5D AS value", "concat('{\"k\":', event_id % 7, '}') AS props", "timestamp_seconds(1700000000 + event_id) AS ts",
    )
    rows.write.parquet(f"{path}/events.parquet")


def test_landed_records_are_written_once(spark, tmp_path):
    """A batch reads lines, not the building of all documents, and both documents come from one grouping without a join."""
    events(spark, tmp_path, 5)
    records = registry.landed_records(spark, str(tmp_path), str(tmp_path))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "json" in plan and not any(n in plan for n in ("Join", "Aggregate", "Exchange", "parquet"))
    assert "Join" not in star.landed_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    apart = [{r["value"] for r in f(spark, str(tmp_path)).collect()} for f in (star.match_documents, star.timeline_documents)]
    got = records.collect()
    assert sorted(r["matchId"] for r in got) == [f"EV_{i}" for i in range(5)]
    for column, texts in zip(("match", "timeline"), apart):
        assert {r[column] for r in got} == {t for t in texts if '"matchId"' in t}


def test_parser_is_planned_once(spark, tmp_path, monkeypatch):
    """Repeats make the chosen texts a union; the parser stays above it and is not written out for each of its parts."""
    plans = []
    real = ingest.ingested
    monkeypatch.setattr(ingest, "ingested", lambda docs: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or real(docs))
    store = MatchStore(spark, str(tmp_path)).create()
    one = frame(spark, [record(i) for i in range(3)])
    ingest.ingest(one.unionByName(one), store, "batch", 0)
    assert plans[0].count("from_json(StructField(metadata") <= 2
    assert store.table("matches").count() == 3


def test_unreadable_and_misnamed_texts_are_kept_whole(spark, tmp_path):
    texts = [(json.dumps(r["match"]), json.dumps(r["timeline"])) for r in map(record, range(4))]
    # Another match's timeline, and one that ends too early but names its match.
    rows = [texts[0], (texts[1][0], texts[2][1]), (texts[3][0], texts[3][1][:-5])]
    store = MatchStore(spark, str(tmp_path)).create()
    ingest.ingest(spark.createDataFrame(rows, ingest.LANDED), store, "batch", 0)
    kept = {(r["match"], r["timeline"]) for r in store.table("rejected").collect()}
    assert rows[1] in kept and kept <= set(rows[1:])
    assert "BR1_0" in {r["matchId"] for r in store.table("matches").collect()}
