"""Token ids of documents in ORC: stripes of run-length coded integers, row indexes, Bloom filters on document ids.

Rows go to files by ranges of doc_id, sorted inside. Each row holds its ids and where it starts within its file, so
that any stripe can be read alone; the start over all files needs one total per file. Readers that ask for some
documents skip files and stripes by the minima and maxima of doc_id and rows by the Bloom filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.bpe import encoder
from matchlake.llm.common import by_bytes, utf8

#: Fixed values of the file format: bytes of a stripe, rows between two index entries, chance that the filter errs.
ORC_OPTIONS = {
    "orc.stripe.size": str(32 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}
#: Bytes of text that are encoded together.
ENCODE_BYTES = 8 << 20
SCHEMA = "file int, doc_id long, start_in_file long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """Ids of every whole text and the end id, in ascending doc_id order over the partitions.

    A null text counts as empty; a null doc_id comes first; rows of one doc_id follow by a hash of their texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, start = encoder(tokenizer), 0
        for batch in batches:
            for part in by_bytes(batch, ENCODE_BYTES):
                ids, counts = bpe.encode_flat(part["text"])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                sizes = counts + 1
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate(([0], ends)), type=pa.int32())
                values = pa.array(ids.view(np.int32))
                yield pa.record_batch(
                    [part["file"], part["doc_id"], pa.array(start + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)],
                    names=["file", "doc_id", "start_in_file", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().alias("file"), "doc_id", "text").mapInArrow(work, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text") -> None:
    encode(docs, tokenizer, end_id, text).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with the start of each over all files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return _placed(rows, spark, path)


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # One row for each file: their running total is small and the same for every reader.
    sums = spark.read.schema(SCHEMA).orc(path).groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, "file").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base", "start_in_file")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids as little-endian 32-bit integers, from the files alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch(
                [batch["file"], batch["doc_id"], batch["start_in_file"], pa.array(np.diff(at), type=pa.int64()), pa.array(sums, type=pa.int64())],
                names=["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
            )

    stored = spark.read.schema(SCHEMA).orc(path).select("file", "doc_id", "start_in_file", "ids")
    rows = stored.mapInArrow(work, "file int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")
    return _placed(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the condition reaches the ORC reader, which skips files, stripes and rows by it."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))
