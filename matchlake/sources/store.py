"""The stored tables: runs of Parquet files, and commits whose manifests name the runs that make up a table.

A run is one write of one table, `<table>/run=b<batch>-<level>-<random>`, and is never changed. A commit is one row for each
live run, `commits/batch=<n>`, written last: what it names is the store at that batch, seen whole or not at all. A reader holds
the paths of the commit that it read, so it goes on while later batches and merges write theirs.

A batch writes a run of level 0 of each table that gets rows. Where FANOUT runs of a level have come together, they are merged
into one of the next level, so a row is written again once for each level: n batches write n log n rows, and a table has at most
FANOUT runs of each level.

    matches, teams, participants, rejected   rows; merging brings a patch's rows and a player's rows together. A run of
                                             FULL_ROWS rows stays as it is, so only small files are written again
    match_ids                                ids by hash bucket, with Bloom filters, for the question whether a match is stored
    <partials>                               partial sums; merging adds up the rows of a key
    players                                  profiles; merging keeps a player's latest profile and first region and time
    sources                                  which batches of which source are in

A batch that is run again before its commit writes new runs; what a lost attempt has left is named by no manifest, and expire()
deletes it with the runs that only old commits name. Batch numbers are the store's own. One writer at a time.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from matchlake.operators import champion_stats as champions, collection, player_stats as players
from matchlake.sources import schemas

SUMS = "gamesPlayed bigint, timedGames bigint, wins bigint, " + ", ".join(
    f"{n}Micros decimal(38,0)" for n in ("kda", "dpm", "gpm", "cspm")
)
PARTIALS = {
    "champion_partials": (champions.CHAMPION_KEYS, f"championId int, patch string, queueId int, {SUMS}"),
    "ban_partials": (champions.CHAMPION_KEYS, "championId int, patch string, queueId int, bans bigint"),
    "match_partials": (["patch", "queueId"], "patch string, queueId int, matches bigint"),
    "player_partials": (
        players.PARTIAL_KEYS,
        f"puuid string, championId int, role string, patch string, queueId int, {SUMS}, visionSum bigint, "
        "opponentGames bigint, csd15Sum bigint, gd15Sum bigint, xpd15Sum bigint, soloKills15Sum bigint, soloDeaths15Sum bigint, "
        "lastPlayedAt bigint",
    ),
}
ROWS = {
    "matches": schemas.MATCHES,
    "teams": schemas.TEAMS,
    "participants": schemas.PARTICIPANTS,
    "rejected": "matchId string, reason string, match string, timeline string",
}
TABLES = {
    **ROWS,
    **{n: ddl for n, (_, ddl) in PARTIALS.items()},
    "match_ids": "bucket int, matchId string",
    "players": schemas.USERS,
    "sources": "source string, sourceBatch bigint, came bigint, stored bigint",
}
MANIFEST = "table string, path string, level int, rows bigint, batch bigint"

#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Rows from which on a run of a row table is not written again.
FULL_ROWS = {"matches": 50_000_000, "teams": 50_000_000, "participants": 5_000_000, "rejected": 1_000_000}
#: Hash buckets of the ids, bytes of a row group of theirs, and up to how many ids are asked for by name.
ID_BUCKETS = 4096
ID_GROUP_BYTES = 4 << 20
ASKED_IDS = 1000


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema in its order and types."""
    fields = StructType.fromDDL(ddl).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def id_bucket(match_id) -> Column:
    return F.pmod(F.xxhash64(match_id), F.lit(ID_BUCKETS)).cast("int")


@dataclass(frozen=True)
class Run:
    table: str
    path: str
    level: int
    rows: int


class MatchStore:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fanout = fanout

    def create(self) -> "MatchStore":
        """Commits the empty store as batch -1."""
        self._commit(-1, [])
        return self

    # -- runs

    def _read(self, runs: list[Run], name: str) -> DataFrame:
        """All rows of the runs of a table."""
        paths = [f"{self.root}/{r.path}" for r in runs if r.table == name]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.select(*StructType.fromDDL(TABLES[name]).names)

    def _write(self, name: str, df: DataFrame, batch: int, level: int) -> Run | None:
        """The rows as a run; none if there are no rows."""
        path = f"{name}/run=b{batch}-{level}-{os.urandom(4).hex()}"
        seen = Observation()
        out = _shaped(df, TABLES[name]).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = out.write
        if name == "match_ids":
            # Small row groups, each with its own range of buckets and its own Bloom filter.
            writer = writer.option("parquet.bloom.filter.enabled#matchId", "true").option("parquet.block.size", ID_GROUP_BYTES)
            writer = writer.option("parquet.bloom.filter.expected.ndv#matchId", ID_GROUP_BYTES // 16)
        elif "patch" in out.columns:
            writer = writer.partitionBy("patch")
        writer.parquet(f"{self.root}/{path}")
        rows = seen.get.get("rows", 0)
        return Run(name, path, level, rows) if rows else None

    def _write_all(self, frames: dict[str, DataFrame], batch: int, level: int = 0) -> list[Run]:
        """Independent tables as jobs side by side, so that the tail of one is filled by the next."""
        with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
            return [r for r in pool.map(lambda item: self._write(item[0], item[1], batch, level), frames.items()) if r]

    def _merged(self, name: str, rows: DataFrame) -> DataFrame:
        """What a merge writes for the rows of some runs: rows that belong together lie together, and keys add up."""
        if name in PARTIALS:
            return champions.merge(rows, PARTIALS[name][0])
        if name == "players":
            return collection.merge_players(rows)
        if name == "match_ids":
            return rows.repartitionByRange("bucket", "matchId").sortWithinPartitions("bucket", "matchId")
        if name == "participants":
            # A player's rows lie together, so a lookup by player skips most row groups.
            return rows.hint("rebalance", "patch").sortWithinPartitions("patch", "puuid")
        return rows.hint("rebalance", "patch") if "patch" in rows.columns else rows.hint("rebalance")

    def _levelled(self, runs: list[Run], batch: int) -> list[Run]:
        """The runs after all merges that are due, lowest level first."""
        while True:
            due: dict[str, list[Run]] = {}
            for name in TABLES:
                open_ = [r for r in runs if r.table == name and r.rows < FULL_ROWS.get(name, float("inf"))]
                for level in sorted({r.level for r in open_}):
                    same = [r for r in open_ if r.level == level]
                    if len(same) >= self.fanout:
                        due[name] = same
                        break
            if not due:
                return runs
            with ThreadPoolExecutor(max_workers=len(due)) as pool:
                made = list(pool.map(lambda n: self._write(n, self._merged(n, self._read(due[n], n)), batch, due[n][0].level + 1), due))
            gone = {r.path for some in due.values() for r in some}
            runs = [r for r in runs if r.path not in gone] + [r for r in made if r]

    # -- commits

    def _commit(self, batch: int, runs: list[Run]) -> None:
        rows = [(r.table, r.path, r.level, r.rows, batch) for r in runs] or [(None, None, None, None, batch)]
        self.spark.createDataFrame(rows, MANIFEST).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/commits")

    def state(self, at: int | None = None) -> tuple[int, list[Run]]:
        """The last committed batch, or the one that is asked for, and its runs."""
        commits = self._commits()
        batch = commits.agg(F.max("batch")).first()[0] if at is None else at
        rows = commits.where(F.col("batch") == batch).collect()  # FANOUT runs a level and table, and the full ones
        if not rows:
            raise ValueError(f"no commit {batch}")
        return batch, [Run(r["table"], r["path"], r["level"], r["rows"]) for r in rows if r["path"] is not None]

    def _save(self, new: list[Run], runs: list[Run], batch: int) -> None:
        self._commit(batch, self._levelled(runs + new, batch))

    def expire(self, keep: int = 10) -> int:
        """Deletes all but the last `keep` commits, and the runs that no commit that stays names; for the writer, between
        batches. Returns how many runs went. Readers of the commits that stay are not touched."""
        batches = sorted(r[0] for r in self._commits().select("batch").distinct().collect())
        stay = batches[-max(1, keep) :]
        named = {r[0] for r in self._commits().where(F.col("batch") >= stay[0]).select("path").distinct().collect()}
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in batches[: -len(stay)]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(home, f"commits/batch={b}"), True)
        gone = 0
        for name in TABLES:
            folder = jvm.org.apache.hadoop.fs.Path(home, name)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{name}/{status.getPath().getName()}" not in named:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    # -- writing

    def has(self, source: str, number: int) -> bool:
        """Whether the source's batch of this number is committed."""
        done = (F.col("source") == source) & (F.col("sourceBatch") == number)
        return not self.table("sources").where(done).isEmpty()

    def save(
        self, source: str, number: int, matches: DataFrame, teams: DataFrame, participants: DataFrame, rejected: DataFrame,
        came: int | None = None, stored: int | None = None,
    ) -> None:
        """Stores one batch of new matches with its ids and partial sums, then commits it. came and stored, the records that
        reached the store's check and those that passed it, are kept with the batch's source."""
        last, runs = self.state()
        batch = last + 1
        new = self._write_all({"participants": participants, "teams": teams, "matches": matches, "rejected": rejected}, batch)
        # The aggregates start from the written rows: nothing is parsed twice, and the lineage ends here.
        m, t, p = (self._read(new, n) for n in ("matches", "teams", "participants"))
        games = champions.game_rows(p, m)
        ids = m.select(id_bucket("matchId").alias("bucket"), "matchId")
        parts = {
            "champion_partials": champions.champion_partials(games),
            "ban_partials": champions.ban_partials(t, m),
            "match_partials": champions.match_partials(m),
            "player_partials": players.player_partials(games),
            "match_ids": ids.repartitionByRange("bucket", "matchId").sortWithinPartitions("bucket", "matchId"),
            "sources": self.spark.createDataFrame([(source, number, came, stored)], TABLES["sources"]).coalesce(1),
        }
        self._save(new + self._write_all(parts, batch), runs, batch)

    def note(self, source: str, number: int, came: int) -> None:
        """Commits a batch of a source that had nothing new."""
        last, runs = self.state()
        row = self.spark.createDataFrame([(source, number, came, 0)], TABLES["sources"]).coalesce(1)
        self._save(self._write_all({"sources": row}, last + 1), runs, last + 1)

    def save_players(self, profiles: DataFrame) -> None:
        """Stores one write of profiles as a batch of its own, then commits it."""
        last, runs = self.state()
        new = self._write_all({"players": collection.merge_players(profiles.withColumn("createdAt", F.col("lastUpdated")))}, last + 1)
        self._save(new, runs, last + 1)

    # -- reading

    def table(self, name: str, at: int | None = None) -> DataFrame:
        """The rows of a table at the last commit, or at an earlier one."""
        return self._read(self.state(at)[1], name)

    def stored_among(self, ids: DataFrame) -> DataFrame:
        """matchId: those of the ids (matchId) that are stored.

        Up to ASKED_IDS ids are asked for by name: row groups of other buckets are skipped by their range, those of an id's
        bucket by their Bloom filter. More ids are worth a reading of the whole index, two narrow columns.
        """
        wanted = ids.where(F.col("matchId").isNotNull()).select("matchId").distinct()
        some = [r[0] for r in wanted.limit(ASKED_IDS + 1).collect()]
        index = self.table("match_ids")
        if len(some) > ASKED_IDS:
            return index.select("matchId").join(wanted, "matchId", "left_semi")
        if not some:
            return index.select("matchId").limit(0)
        buckets = dict(self.spark.createDataFrame([(i,) for i in some], "matchId string").select("matchId", id_bucket("matchId")).collect())
        asked = [(F.col("bucket") == buckets[i]) & (F.col("matchId") == i) for i in sorted(some, key=buckets.get)]
        while len(asked) > 1:  # a balanced tree of conditions
            asked = [a | b for a, b in zip(asked[::2], asked[1::2])] + ([asked[-1]] if len(asked) % 2 else [])
        return index.where(asked[0]).select("matchId")

    def partials(self, name: str, runs: list[Run] | None = None) -> DataFrame:
        runs = self.state()[1] if runs is None else runs
        return champions.merge(self._read(runs, name), PARTIALS[name][0])

    def champion_stats(self) -> DataFrame:
        _, runs = self.state()
        return champions.champion_stats(*(self.partials(n, runs) for n in ("champion_partials", "ban_partials", "match_partials")))

    def player_partials(self) -> DataFrame:
        return self.partials("player_partials")

    def players(self) -> DataFrame:
        """Profiles, latest write first, region and creation time from the first write."""
        return collection.merge_players(self.table("players"))
