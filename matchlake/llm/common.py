"""What the training-data operators share: tables, intermediate results on the shared folder, words."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.session import new_work_dir

#: Fixed value: what separates words; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet below the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_work_dir(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that no column of the rows has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_rows(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over batches cut by bytes, so that very long texts do not meet in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                yield work(part)

    return df.mapInArrow(run, schema)


_held: tuple | None = None


def worker_table(key: object, make: Callable[[], Any]) -> Any:
    """The one large table that a Python worker keeps from task to task. Asking for another one drops it, so that the
    tables of operators that follow one another in a worker do not add up."""
    global _held
    if _held is None or _held[0] != key:
        _held = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held = (key, make())
    return _held[1]


def no_table() -> None:
    """For operators that keep nothing: drops what an earlier one has kept."""
    worker_table(None, lambda: None)


#: Bytes of input that one step of a Python operator takes at most, a single longer row aside.
STEP_BYTES = 4 << 20


def by_bytes(batch: pa.RecordBatch, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(limit * rows / max(1, batch.get_total_buffer_size()))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def utf8(column: str = "text"):
    """The text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
