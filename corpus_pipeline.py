"""Documents to training data: quality, near duplicates, secrets, mixture, token ids.

Each stage works on the Parquet files that the stage before it wrote, and all but the last return documents' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchlake.llm import mixing, near_dups, pieces, quality, secrets_scan
from matchlake.llm.common import table, written
from matchlake.llm.queries import PIECES


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that both views together reject."""
    return quality.apply(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dups.apply(docs, 80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts."""
    return secrets_scan.apply(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask."""
    return mixing.apply(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and whether they decode to its text."""
    return pieces.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_distinct),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: Classifiers, networks and piece searches are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
