"""The registered queries of the training-data operators; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import (
    decontamination, embedding_dups, fingerprints, licenses, mixing, near_dups, oracle, periodic_runs, phrases, pieces, quality, secrets_scan,
    token_counts, token_files,
)
from matchlake.llm.common import WORD, table, utf8
from matchlake.session import new_work_dir

QUERIES: dict = {}
#: SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_near_dups": oracle.NEAR_DUPS,
    "op3_fingerprints": oracle.FINGERPRINTS,
    "op4_licenses": oracle.LICENSES,
    "op7_source_mix": oracle.SOURCE_MIX,
    "op9_embedding_dups": oracle.EMBEDDINGS,
    "op11_decontamination": oracle.DECONTAMINATION,
    "op13_phrases": oracle.PHRASES,
}

#: Parameters of the queries: vocabulary files and the id that ends a document.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to ORC and read back: start, count and CRC of each."""
    path = f"{new_work_dir(spark, 'token-files')}/orc"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), END_ID)
    return token_files.digests(spark, path)


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mixture to target weights takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each document to be good by the text view, the page view and both, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by the base patterns and by the network."""
    docs = table(spark, sf_dir, "documents")
    return secrets_scan.scan(docs, secrets_scan.fit(docs))


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document: number, CRC, and whether they decode to the text."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every section of every document, the document encoded as a whole."""
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document, of its edited text, and how alike they are."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that holds for each document; it lies in a folder of its source, language and hundred of ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 100 AS string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.withColumn("path", path))


@query
def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that are alike by 85 of 100 of their shingles of five words."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), 85)


@query
def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of 0.9 and more."""
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten words of a benchmark item, and the items they are from."""
    return decontamination.digests(decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents, where the tail of each tenth one (by the CRC-32 of its id) is overwritten by its own beginning, again
    and again: with g = floor(crc / 10) and n words, each word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)). A null id has no CRC: such rows stay as they are."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("crc div 10")

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    # A one-element array binds the words to a name, so that they are cut out once.
    words = F.array(F.regexp_extract_all(utf8(), F.lit(WORD), F.lit(0)))
    some = (F.col("crc") % 10 == 0) & utf8().rlike(WORD)
    text = F.when(some, F.get(F.transform(words, repeated), F.lit(0))).otherwise(F.col("text"))
    return docs.withColumn("crc", crc).withColumn("text", text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document with its repeats, the longest, and the text without the repetitions."""
    return periodic_runs.digests(periodic_runs.find(with_repeats(table(spark, sf_dir, "documents"))))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language with 30 occurrences and more."""
    return phrases.collocations(table(spark, sf_dir, "documents"), support=30, inside_share=80, most=2000)
