"""Continuous ingest: landed documents to stored tables and aggregates.

A landed record is one JSON object per match with its two documents, `match` and `timeline`, inline or as
text. Records without a timeline are skipped, as are matches the store already has. Records that cannot be read, or whose
documents name different matches, go to the table `rejected`.

What is to be stored is decided on narrow rows, ids and hashes of the texts. Texts, about a megabyte a timeline, are read
again for the records that are chosen and are not shuffled.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchlake.operators.timeline_parser import with_results
from matchlake.plans.reports import ingested
from matchlake.sources import schemas
from matchlake.sources.store import MatchStore

LANDED = "match string, timeline string"

#: Files of a micro-batch, unless the caller says otherwise: a first run over a full folder comes in bounded batches.
FILES_PER_TRIGGER = 1000
#: How long the stream remembers a record that came in, so that its repeats end before the store is asked.
REMEMBERED = "2 hours"
#: Up to so many chosen records, some 40 bytes each, go to all tasks at once.
BROADCAST_ROWS = 1_000_000


def text_hash() -> Column:
    return F.xxhash64("match", "timeline")


def identified(records: DataFrame) -> DataFrame:
    """Narrow rows: the ids that a record's texts name, the match's creation time and a hash of both texts."""
    return records.select(
        F.get_json_object("match", "$.metadata.matchId").alias("matchId"),
        F.get_json_object("timeline", "$.metadata.matchId").alias("timelineId"),
        F.get_json_object("match", "$.info.gameCreation").try_cast("long").alias("created"),
        F.col("timeline").isNotNull().alias("timed"),
        text_hash().alias("textHash"),
        *[c for c in ("path", "arrived") if c in records.columns],
    )


def chosen(named: DataFrame) -> DataFrame:
    """(matchId, textHash): the record of each match id that counts: the earliest creation time, then the smallest hash."""
    usable = named.where(F.col("matchId").isNotNull() & (F.col("timelineId") == F.col("matchId")))
    first = F.min(F.struct(F.col("created").isNull().alias("untimed"), "created", "textHash"))
    return usable.groupBy("matchId").agg(first.alias("first")).select("matchId", F.col("first.textHash").alias("textHash"))


def unseen(wanted: DataFrame, store: MatchStore) -> DataFrame:
    """Those of (matchId, textHash) that are not stored, by id alone: a match sent again with another time, or none, is found too."""
    return wanted.join(store.stored_among(wanted), "matchId", "left_anti")


def texts_of(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records (match, timeline) with a wanted textHash, each text once. Only texts that came more than once are shuffled."""
    narrow = wanted.select("textHash").persist(StorageLevel.MEMORY_AND_DISK)
    small = narrow.count() <= BROADCAST_ROWS
    near = lambda df: F.broadcast(df) if small else df
    hashed = records.select("match", "timeline", text_hash().alias("textHash"))
    counts = hashed.select("textHash").join(near(narrow), "textHash", "left_semi").groupBy("textHash").agg(F.count("*").alias("n"))
    repeated = [r[0] for r in counts.where("n > 1").select("textHash").limit(1).collect()]
    if not repeated:
        return hashed.join(near(narrow), "textHash", "left_semi")
    again = counts.where("n > 1").select("textHash").persist(StorageLevel.MEMORY_AND_DISK)
    once = hashed.join(near(narrow.join(again, "textHash", "left_anti")), "textHash", "left_semi")
    return once.unionByName(hashed.join(near(again), "textHash", "left_semi").dropDuplicates(["textHash"]))


def parsed(records: DataFrame) -> DataFrame:
    """Both documents of a record parsed and paired inside its row; the match is null where a text cannot be read."""
    docs = records.select(
        "match", "timeline", "textHash",
        F.from_json("match", schemas.MATCH).alias("m"), F.from_json("timeline", schemas.TIMELINE).alias("t"),
    ).select(
        "match",
        "timeline",
        "textHash",
        F.when(F.col("m.metadata.matchId") == F.col("t.metadata.matchId"), F.col("m.metadata.matchId")).alias("matchId"),
        F.col("m.metadata").alias("metadata"),
        F.col("m.info").alias("info"),
        F.col("t.metadata.participants").alias("ids"),
        F.col("t.info.frames").alias("frames"),
    )
    return with_results(docs)


def unnamed(named: DataFrame) -> DataFrame:
    """Narrow rows that cannot be stored, with the reason. One without a timeline is left out by design and is none of them."""
    reason = (
        F.when(F.col("matchId").isNull(), F.lit("match without an id"))
        .when(F.col("timelineId").isNull(), F.lit("timeline without an id"))
        .when(F.col("timelineId") != F.col("matchId"), F.lit("ids differ"))
    )
    return named.where("timed").withColumn("reason", reason).where("reason IS NOT NULL").select("matchId", "textHash", "reason").distinct()


def ingest(records: DataFrame, store: MatchStore, source: str, number: int) -> None:
    """One batch of a source, under the number that the source gives it.

    Safe to run again: what the source has already committed under this number is skipped, an unfinished batch is
    written anew. The store's own batch numbers are its own, so sources do not get into each other's way. One writer at a time.
    """
    if not store.has(source, number):
        store_batch(identified(records), records, store, source, number)


def store_batch(named: DataFrame, records: DataFrame, store: MatchStore, source: str, number: int) -> None:
    """named are the narrow rows of the batch, records the texts they are from."""
    named = named.persist(StorageLevel.MEMORY_AND_DISK)
    new = unseen(chosen(named), store).persist(StorageLevel.MEMORY_AND_DISK)
    came, stored = named.where("matchId = timelineId").count(), new.count()
    bad = unnamed(named).persist(StorageLevel.MEMORY_AND_DISK)
    if not stored and bad.isEmpty():
        store.note(source, number, came)
        return
    # Parsed rows are read for each table. Lost blocks are parsed again.
    # The texts stay with the records that turn out to be unreadable only.
    kept = {c: F.when(F.col("matchId").isNull(), F.col(c)) for c in ("match", "timeline")}
    # Measured, the texts are one table to the optimizer: it would write the parser out for each part of a union otherwise.
    texts = texts_of(records, new).observe("texts", F.count(F.lit(1)).alias("rows"))
    docs = parsed(texts).withColumns(kept).persist(StorageLevel.MEMORY_AND_DISK)
    good = docs.where("matchId IS NOT NULL").drop("match", "timeline", "textHash")
    columns = ["matchId", "reason", "match", "timeline"]
    broken = docs.where("matchId IS NULL").drop("matchId").join(new, "textHash").withColumn("reason", F.lit("unreadable document")).select(*columns)
    wrong = bad.count()
    if wrong:
        hashed = records.select("match", "timeline", text_hash().alias("textHash"))
        broken = broken.unionByName(hashed.join(F.broadcast(bad) if wrong <= BROADCAST_ROWS else bad, "textHash").select(*columns))
    store.save(source, number, *ingested(good), broken, came=came, stored=stored)
    for held in (docs, bad, new, named):
        held.unpersist()


def _stream_source(spark: SparkSession, checkpoint: str) -> str:
    """Name of the stream, kept inside its checkpoint: a lost checkpoint begins its numbers anew, under another name."""
    path = f"{checkpoint}/ingest_source"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    name = f"stream-{os.urandom(8).hex()}"
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(path)
    return name


def first_seen(named: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """A stream of narrow rows (matchId, textHash, arrived, ...) without those that came before within the time remembered.

    The state holds one short row for each record and lets it go when the watermark has passed it. What comes again later,
    or with another text, passes and is found by the store's ids.
    """
    return named.withWatermark("arrived", remembered).dropDuplicatesWithinWatermark(["matchId", "textHash"])


def start(
    spark: SparkSession,
    landing: str,
    store: MatchStore,
    available_now: bool = False,
    files_per_trigger: int | None = None,
    remembered: str = REMEMBERED,
    clock: Column | None = None,
    landed: str = LANDED,
):
    """Starts the stream. Its checkpoint lives inside the store.

    clock is when a record arrives, the time of its micro-batch unless the records bring one along (in a column of `landed`).
    A record whose own clock is more than `remembered` behind the others' is lost, so such a clock has to be that of the landing.
    """
    checkpoint = f"{store.root}/_stream"
    source = _stream_source(spark, checkpoint)
    files = spark.readStream.schema(landed).option("maxFilesPerTrigger", files_per_trigger or FILES_PER_TRIGGER).json(landing)
    rows = files.select("match", "timeline", F.col("_metadata.file_path").alias("path"), (F.current_timestamp() if clock is None else clock).alias("arrived"))

    def batch(named: DataFrame, number: int) -> None:
        named = named.persist(StorageLevel.MEMORY_AND_DISK)
        if named.isEmpty() or store.has(source, number):  # a batch without rows only moves the watermark
            return
        paths = [unquote(r[0]) for r in named.select("path").distinct().collect()]  # as many as a trigger takes
        records = spark.read.schema(LANDED).json(paths) if paths else spark.createDataFrame([], LANDED)
        store_batch(named.drop("path", "arrived"), records, store, source, number)
        named.unpersist()

    writer = first_seen(identified(rows), remembered).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_available(spark: SparkSession, landing: str, store: MatchStore, files_per_trigger: int | None = None, **more) -> None:
    start(spark, landing, store, True, files_per_trigger, **more).awaitTermination()
