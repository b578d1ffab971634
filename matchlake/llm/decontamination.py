"""Benchmark decontamination: which words of the documents lie in passages of test questions and answers.

A window is WINDOW consecutive words of an item, or the whole of a shorter one. One Aho-Corasick automaton holds the
windows of the normalised items; each document is normalised the same way and read once, and what is hit is mapped back to
places of the original text. Words are the automaton's letters: each known word is written as two characters of alphabets
that do not meet, so that a state has few ways on and a match cannot begin inside a word.

A benchmark of more than AUTOMATON_WORDS words is dealt to several automata of about that size. Only one of them is on
the driver and in a worker at a time; each reads all documents, and the hits of a document are then joined.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import arrow_rows, utf8, worker_table, written

WINDOW = 10
#: Words of items in one automaton, about 0.9 KB of memory each, and in one piece of an item.
AUTOMATON_WORDS = 200_000
PIECE_WORDS = 1000
#: Words of a text in small letters, and the same rule on UTF-8 bytes, where every byte beyond ASCII is of a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNKNOWN = "\0\0"

SPANS = "array<struct<first:int,after:int,start:long,end:long>>"
HITS = f"doc_id long, key string, n_words long, items array<long>, spans {SPANS}"


def pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words): distinct pieces of the items' words. Pieces overlap by a window less one word, so that each
    window is whole in one; an item is never cut into pieces shorter than a window."""
    words = F.regexp_extract_all(F.translate(utf8(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(PIECE_WORDS))
    rows = rows.select("item_id", "words", F.explode(starts).alias("start"))
    return rows.select("item_id", F.slice("words", F.col("start") + 1, PIECE_WORDS + WINDOW - 1).alias("words")).distinct()


class Windows:
    """The automaton over the windows of some pieces, and the items of each window."""

    def __init__(self, rows: list[tuple[int | None, list[str]]]):
        words = sorted({w for _, piece in rows for w in piece})
        base = math.isqrt(len(words)) + 1
        letters = [chr(c) for c in range(1, 0xD800)]
        if 2 * base > len(letters):
            raise ValueError("too many distinct words for one automaton")
        self.code = {w.encode(): letters[i // base] + letters[base + i % base] for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.items: list[set[int]] = []
        for item, piece in rows:
            coded = [self.code[w.encode()] for w in piece]
            size = min(WINDOW, len(coded))
            for i in range(len(coded) - size + 1):
                key = "".join(coded[i : i + size])
                _, place = self.automaton.get(key, (0, -1))
                if place < 0:
                    place = len(self.items)
                    self.automaton.add_word(key, (size, place))
                    self.items.append(set())
                if item is not None:
                    self.items[place].add(item)
        if self.items:
            self.automaton.make_automaton()

    def hits(self, raw: bytes) -> tuple[int, list[int], list[tuple[int, int, int, int]]]:
        """Number of words of a text, the items of the windows that occur, and the spans of words that these cover: word
        numbers, and places of the original text in code points, ends exclusive."""
        normal = raw.translate(NORMAL)
        words = normal.split()
        if not self.items or not words:
            return len(words), [], []
        coded = list(map(self.code.get, words, repeat(UNKNOWN)))
        found, change = set(), None
        for end, (size, place) in self.automaton.iter("".join(coded)):
            if change is None:
                change = np.zeros(len(words) + 1, dtype=np.int32)
            last = end >> 1
            change[last - size + 1] += 1
            change[last + 1] -= 1
            found.add(place)
        if change is None:
            return len(words), [], []
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(change) > 0, [0])).astype(np.int8)))
        first, after = edges[::2], edges[1::2]
        inside = np.concatenate(([0], np.frombuffer(normal, np.uint8) != 32, [0])).astype(np.int8)
        sides = np.flatnonzero(np.diff(inside))
        # Code points before a byte: those bytes that begin one.
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        start, end = points[sides[::2][first]], points[sides[1::2][after - 1]]
        items = sorted(set().union(*(self.items[p] for p in found)))
        return len(words), items, list(zip(first.tolist(), after.tolist(), start.tolist(), end.tolist()))


def _read(docs: DataFrame, rows: list[tuple[int | None, list[str]]]) -> DataFrame:
    """Every row of docs (doc_id, key, text) read by the automaton of these pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # about AUTOMATON_WORDS words
    token = os.urandom(8)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        windows = worker_table(("decontamination", token), lambda: Windows(shared.value))
        found = [windows.hits(t) for t in part["text"].cast(pa.binary()).to_pylist()]
        spans = [[dict(zip(("first", "after", "start", "end"), s)) for s in x[2]] for x in found]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        columns = [part["doc_id"], part["key"], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array(spans, kind)]
        return pa.record_batch(columns, names=["doc_id", "key", "n_words", "items", "spans"])

    return arrow_rows(docs, run, HITS)


def _joined(hits: DataFrame) -> DataFrame:
    """(doc_id, key, items, spans) of the hits of several automata: each text's spans put together."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        items, spans = [], []
        for lists, found in zip(part["items"].to_pylist(), part["spans"].to_pylist()):
            items.append(sorted(set().union(*lists)))
            own: list[dict] = []
            for s in sorted((s for x in found for s in x), key=lambda s: (s["first"], s["after"])):
                if own and s["first"] <= own[-1]["after"]:
                    if s["after"] > own[-1]["after"]:
                        own[-1] |= {"after": s["after"], "end": s["end"]}
                else:
                    own.append(dict(s))
            spans.append(own)
        return pa.record_batch([part["doc_id"], part["key"], pa.array(items, pa.list_(pa.int64())), pa.array(spans, part["spans"].type.value_type)], names=["doc_id", "key", "items", "spans"])

    # One row for each automaton and text: rows of the same id and text have the same hits.
    once = hits.distinct().groupBy("doc_id", "key").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    return arrow_rows(once, run, f"doc_id long, key string, items array<long>, spans {SPANS}")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans of every row of docs.

    n_hit words lie in occurrences of windows; items are the ids of the items with a window that occurs, ascending, each
    once; spans are the maximal stretches of hit words, as word numbers (first, after) and as code points of the original
    text (start, end). Null texts and texts without words have no hits; items without words have no windows; items without
    an id hit words but are not listed; rows of one item_id are one item. Repeated rows of docs come out as often. An empty
    benchmark hits nothing, an empty table gives no rows; other columns play no part.
    """
    parts = written(pieces(benchmark), "benchmark-pieces")
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    many = max(1, math.ceil(total / automaton_words))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256) if many > 1 else F.lit(""))

    def share(k: int) -> list[tuple[int | None, list[str]]]:
        own = parts.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(many)) == k)
        return [(r["item_id"], r["words"]) for r in own.collect()]  # about automaton_words words

    if many == 1:
        out = _read(rows, share(0))
    else:
        reads: Iterator[DataFrame] = (written(_read(rows, share(k)).where("size(spans) > 0" if k else "true"), "benchmark-hits") for k in range(many))
        first = next(reads)
        hits = first.where("size(spans) > 0")
        for other in reads:
            hits = hits.unionByName(other)
        found = _joined(hits.select("doc_id", "key", "items", "spans")).withColumnsRenamed({"doc_id": "hit_id", "key": "hit_key"})
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
        out = first.select("doc_id", "key", "n_words").join(found, same, "left")
        out = out.withColumns({"items": F.coalesce("items", F.array().cast("array<long>")), "spans": F.coalesce("spans", F.array().cast(SPANS))})
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return out.select("doc_id", "n_words", covered.alias("n_hit"), "items", "spans")


def digests(found: DataFrame) -> DataFrame:
    """scan()'s rows with the items as a number and a digest: their ids as strings in string order, comma-joined."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
