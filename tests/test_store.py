"""Runs, levels, commits, the id index, and the stream's memory of what came in."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F
from test_ingest import frame, record, state

from matchlake.sources import store as stores
from matchlake.sources.store import MatchStore
from matchlake.streaming import ingest


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Four batches of one match each, two runs to a merge, and what a reader of batch 2 holds."""
    store = MatchStore(spark, str(tmp_path_factory.mktemp("many")), fanout=2).create()
    held = None
    for i in range(4):
        ingest.ingest(frame(spark, [record(i)]), store, "batch", i)
        if i == 2:
            held = store.table("matches"), store.partials("player_partials")
    return store, held


def test_levels_bound_the_runs_and_the_writes(spark, many):
    store, _ = many
    last, runs = store.state()
    assert last == 3
    for name in ("matches", "participants", "player_partials", "match_ids", "sources"):
        levels = [r.level for r in runs if r.table == name]
        assert levels == [2], (name, levels)  # four runs, two, one
    written = [p.name for p in pathlib.Path(store.root, "match_ids").iterdir()]
    assert len(written) == 4 + 2 + 1


def test_merged_runs_are_what_one_batch_writes(spark, many, tmp_path):
    store, _ = many
    whole = MatchStore(spark, str(tmp_path)).create()
    ingest.ingest(frame(spark, [record(i) for i in range(4)]), whole, "batch", 0)
    assert state(store) == state(whole)
    key = lambda r: (r["matchId"], r["pos"])
    assert sorted(store.table("participants").collect(), key=key) == sorted(whole.table("participants").collect(), key=key)


def test_readers_of_an_earlier_commit_go_on(many):
    store, (matches, partials) = many
    assert matches.count() == 3 and partials.agg(F.sum("gamesPlayed")).first()[0] == 30
    assert store.table("matches", at=1).count() == 2 and store.table("matches").count() == 4
    with pytest.raises(ValueError):
        store.table("matches", at=99)


def test_expired_commits_and_runs_go_and_the_last_stay(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path), fanout=2).create()
    for i in range(3):
        ingest.ingest(frame(spark, [record(i)]), store, "batch", i)
    before = state(store)
    orphan = pathlib.Path(store.root, "matches", "run=b9-0-lost")
    orphan.mkdir()
    assert store.expire(keep=1) > 5 and not orphan.exists()
    assert state(store) == before and store.table("matches").count() == 3
    assert len(list(pathlib.Path(store.root, "commits").glob("batch=*"))) == 1
    ingest.ingest(frame(spark, [record(2), record(3)]), store, "batch", 5)
    assert store.table("matches").count() == 4


def test_full_runs_are_not_written_again(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(stores.FULL_ROWS, "participants", 10)
    store = MatchStore(spark, str(tmp_path), fanout=2).create()
    for i in range(3):
        ingest.ingest(frame(spark, [record(i)]), store, "batch", i)
    assert [r.level for r in store.state()[1] if r.table == "participants"] == [0, 0, 0]
    assert store.table("participants").count() == 30


def test_index_finds_stored_ids_alone(spark, tmp_path, monkeypatch):
    store = MatchStore(spark, str(tmp_path), fanout=2).create()
    monkeypatch.setattr(MatchStore, "_save", lambda self, new, runs, batch: self._commit(batch, runs + new))
    rows = spark.range(20_000).select(F.concat(F.lit("BR1_"), "id").alias("matchId"))
    for batch, part in enumerate((rows.where("id % 2 = 0"), rows.where("id % 2 = 1 AND id < 10000"))):
        ids = part.select(stores.id_bucket("matchId").alias("bucket"), "matchId").repartitionByRange(3, "bucket").sortWithinPartitions("bucket", "matchId")
        store._save(store._write_all({"match_ids": ids}, batch), store.state()[1], batch)
    asked = spark.createDataFrame([("BR1_4",), ("BR1_9999",), ("BR1_10001",), ("X",), (None,), ("BR1_4",)], "matchId string")
    found = store.stored_among(asked)
    assert sorted(r[0] for r in found.collect()) == ["BR1_4", "BR1_9999"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(bucket," in plan and "EqualTo(matchId," in plan
    wide = store.stored_among(rows.select("matchId"))  # more than are asked for by name
    assert wide.count() == 15_000
    assert store.stored_among(asked.limit(0)).count() == 0


def test_bloom_filters_are_written(spark, many):
    import pyarrow.parquet as pq

    store, _ = many
    path = next(pathlib.Path(store.root, next(r.path for r in store.state()[1] if r.table == "match_ids")).glob("*.parquet"))
    raw = path.read_bytes()
    meta = pq.ParquetFile(path).metadata
    assert meta.num_rows == 4 and meta.row_group(0).num_rows == 4
    # The filter's bits lie in the file beside the four short ids.
    assert len(raw) > 100_000


def test_identical_records_of_a_batch_are_stored_once(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path)).create()
    ingest.ingest(frame(spark, [record(0)] * 3 + [record(1)]), store, "batch", 0)
    assert store.table("participants").count() == 20 and store.table("matches").count() == 2


def test_opponents_inside_the_row_are_those_of_the_join(spark, tmp_path):
    from matchlake.operators import player_stats

    records = [record(i) for i in range(2)]
    people = records[0]["match"]["info"]["participants"]
    people[3]["teamPosition"], people[7]["teamId"], people[1]["teamPosition"] = "TOP", None, None
    store = MatchStore(spark, str(tmp_path)).create()
    ingest.ingest(frame(spark, records), store, "batch", 0)
    rows = store.table("participants")
    names = ["hasOpponent", *player_stats.LANING]
    joined = player_stats.with_laning(rows.drop(*names)).select("matchId", "pos", *names)
    key = lambda r: (r["matchId"], r["pos"])
    assert sorted(joined.collect(), key=key) == sorted(rows.select("matchId", "pos", *names).collect(), key=key)


def test_stream_forgets_behind_the_watermark_and_the_ids_do_not(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store")).create()
    landing = tmp_path / "landing"
    landing.mkdir()
    waves = [("2020-01-01 00:00:00", [0, 1, 1]), ("2020-01-01 00:10:00", [0, 1, 2]), ("2020-01-03 00:00:00", [3]), ("2020-01-03 00:10:00", [0, 1, 2, 3])]
    for number, (at, ids) in enumerate(waves):
        lines = [json.dumps({**record(i), "landedAt": at}) for i in ids]
        (landing / f"{number}.json").write_text("\n".join(lines))
        ingest.run_available(spark, str(landing), store, remembered="1 hour", clock=F.col("landedAt"), landed=ingest.LANDED + ", landedAt timestamp")
    seen = store.table("sources").where("came > 0").orderBy("sourceBatch").select("came", "stored").collect()
    # Repeats within the hour end in the stream; two days later its memory has only the latest, and the store finds the rest.
    assert [tuple(r) for r in seen] == [(2, 2), (1, 1), (1, 1), (3, 0)]
    assert store.table("matches").count() == 4


def test_paths_with_blanks_and_percent_signs(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store")).create()
    landing = tmp_path / "land ing"
    landing.mkdir()
    (landing / "a b%20c.json").write_text(json.dumps(record(0)))
    ingest.run_available(spark, str(landing), store)
    assert store.table("matches").count() == 1
