"""Phrases whose words come together more often than alone, mined by SON partitioning.

The documents are dealt into SHARDS by hash. A phrase with SUPPORT occurrences has at least SUPPORT / SHARDS of them in one
shard, however the shards turn out, so each shard is mined completely at that lowered support: level by level, where a
phrase of n words is counted only if its first and its last n - 1 words are frequent in the shard. The union of what is
frequent in some shard holds every frequent phrase; a last reading counts all of its phrases in all documents, as text.

Shards are as large as the data asks, so each level is one grouping over all of them. Workers count a few megabytes of text
with numpy and hand on numbers: a hash of language and words, the shard in its last bits. Hashes and the filters made of
them, bitmaps of bounded size, let too many phrases through and never too few; the numbers of the result are counted by text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import by_bytes, no_table, utf8, written

LONGEST = 4
#: Shards, at most 8 as their number takes three bits of a key.
SHARDS = 5
#: Bytes of text that are counted at once, and phrases with their numbers that a worker holds before it hands them on.
CHUNK_BYTES = 2 << 20
HELD_PHRASES = 200_000
#: Bits of a filter for each of its keys, and the most bits it may have: 16 MB in each worker. A fuller one lets more through.
KEY_BITS, MOST_BITS = 16, 1 << 27
#: Parts in which a language's phrases are ranked before the best of the parts are.
RANKED_PARTS = 32

#: What ends a piece, and what separates its words; words run over anything else.
PIECE_ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
#: Small letters, one byte for all gaps, and one that UTF-8 does not have for the ends of pieces.
END = 0xFF
PLAIN = bytes(END if c in PIECE_ENDS else 32 if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CUT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
_S, _T, _SHARD = np.uint64(32), np.uint64(29), np.uint64(7)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    return x ^ (x >> _T)


def _eights(low: bytes, at: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on, as numbers; low has eight bytes more behind them all."""
    return np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))[at] & _CUT[cut]


class Chunk:
    """The words of some texts that follow one another, and the keys of phrases up to `longest` words.

    raw holds plain bytes, the texts each with an end behind it; starts are the places where segments begin, which are of one
    language (a number) and shard. Phrases do not reach over an end. The first `known` words repeat the end of the chunk before;
    phrases that end in them are counted there.
    """

    def __init__(self, raw: bytes, starts: list[int], langs: list[int], shards: list[int], salts: np.ndarray, known: int, longest: int):
        self.raw, self.known = raw, known
        inside = np.zeros(len(raw) + 2, dtype=bool)
        one = np.frombuffer(raw, np.uint8)
        np.not_equal(one, 32, out=inside[1:-1])
        inside[1:-1] &= one != END
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begins, self.ends = edges[::2], edges[1::2]
        segment = np.searchsorted(np.array(starts), self.begins, "right") - 1
        self.lang, self.shard = np.array(langs, np.int64)[segment], np.array(shards, np.uint64)[segment]
        self.piece = np.searchsorted(np.flatnonzero(one == END), self.begins)
        padded, self.lengths = raw + bytes(8), self.ends - self.begins
        first = np.minimum(self.lengths, 8)
        #: A word of up to 16 bytes is told by these two numbers and its length; of a longer one the hash reads up to 32.
        self.head, self.tail = _eights(padded, self.begins, first), _eights(padded, self.ends - first, first)
        hashes = self.head * _M1 + _mixed(self.tail + self.lengths.astype(np.uint64)) * _M2
        long = np.flatnonzero(self.lengths > 16)
        inner = np.minimum(self.lengths[long] - 16, 8)
        hashes[long] += _mixed(_eights(padded, self.begins[long] + 8, inner)) + _eights(padded, self.ends[long] - 8 - inner, inner) * _M1
        hashes = _mixed(hashes)
        #: By number of words: keys of all places, and which places begin a phrase of so many words within a piece.
        self.keys = {1: _mixed(hashes + salts[self.lang])}
        self.valid = {1: np.ones(len(hashes), dtype=bool)}
        for n in range(2, longest + 1):
            last = hashes[n - 1 :]
            self.keys[n] = _mixed(self.keys[n - 1][: len(last)] * _M2 + last)
            self.valid[n] = self.piece[: len(last)] == self.piece[n - 1 :]

    def in_shard(self, n: int) -> np.ndarray:
        """Keys of the phrases of n words within their shard."""
        return (self.keys[n] & ~_SHARD) | self.shard[: len(self.keys[n])]

    def counted_here(self, n: int) -> np.ndarray:
        """Which places begin a phrase of n words that belongs to this chunk."""
        here = self.valid[n].copy()
        here[: max(0, self.known - n + 1)] = False
        return here

    def last_words(self, most: int) -> tuple[bytes, int]:
        """The bytes of at most so many last words, with an end behind them if one follows, and their number."""
        number = min(most, len(self.begins))
        if not number:
            return b"", 0
        ended = bytes([END]) in self.raw[self.ends[-1] :]
        return self.raw[self.begins[-number] : self.ends[-1]] + (bytes([END]) if ended else b" "), number

    def numbers(self) -> np.ndarray:
        """A number for each distinct word, by its bytes and not by a hash."""
        head, tail, known = self.head.copy(), self.tail.copy(), {}
        for i in np.flatnonzero(self.lengths > 16).tolist():
            head[i] = known.setdefault(self.raw[self.begins[i] : self.ends[i]], len(known))
            tail[i] = 0
        length = np.minimum(self.lengths, 17).astype(np.uint64)
        _, first, number = np.unique(_mixed(head * _M1 + _mixed(tail + length) * _M2), return_index=True, return_inverse=True)
        same = first[number]
        if (head == head[same]).all() and (tail == tail[same]).all() and (length == length[same]).all():
            return number
        return np.unique(np.column_stack((head, tail, length)), axis=0, return_inverse=True)[1].reshape(-1)

    def texts(self, at: np.ndarray, n: int) -> Iterator[bytes]:
        """The phrases of n words at these places, their words parted by one blank."""
        begins, ends = self.begins[at], self.ends[at + n - 1]
        letters = np.concatenate(([0], np.cumsum(self.lengths)))
        plain = ends - begins == letters[at + n] - letters[at] + n - 1
        for a, b, whole in zip(begins.tolist(), ends.tolist(), plain.tolist()):
            yield self.raw[a:b] if whole else b" ".join(self.raw[a:b].split())


def _chunks(batch: pa.RecordBatch, longest: int = LONGEST) -> Iterator[tuple[list[str], Chunk]]:
    """The batch's texts in chunks, with the names of the languages that are numbered in them."""
    texts = batch["text"].cast(pa.binary())
    coded = batch["lang"].dictionary_encode()
    names, langs, shards = coded.dictionary.to_pylist(), coded.indices.to_pylist(), batch["shard"].to_pylist()
    salts = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in names], dtype=np.uint64)
    held: list[bytes] = []
    starts: list[int] = []
    of: list[int] = []
    size, known = 0, 0

    def made() -> Chunk:
        return Chunk(b"".join(held), starts, [langs[i] for i in of], [shards[i] for i in of], salts, known, longest)

    for i in range(len(texts)):
        raw, at = texts[i].as_py().translate(PLAIN) + bytes([END]), 0
        while at < len(raw):
            # A cut falls between words, so a very long text comes in parts.
            near = [raw.find(c, at + CHUNK_BYTES) for c in (b" ", bytes([END]))] if len(raw) - at > CHUNK_BYTES else []
            end = min((x for x in near if x >= 0), default=len(raw))
            held.append(raw[at:end])
            starts.append(size)
            of.append(i)
            size += end - at
            at = end
            if size >= CHUNK_BYTES:
                chunk = made()
                yield names, chunk
                again, known = chunk.last_words(LONGEST - 1)
                held, starts, of, size = [again], [0], [i], len(again)  # of the same text's language and shard
    if held and len(held) > (known > 0):
        yield names, made()


class Filter:
    """A bitmap of keys: those that were put in are found, and few others."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)

    @staticmethod
    def places(keys: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        first = _mixed(keys * _M2)
        return first >> shift, _mixed(first + _M2) >> shift

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, self.shift):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def filter_of(keys: DataFrame) -> Filter:
    """The filter of a column `key` of numbers: bits set by the workers, joined by Spark, at most MOST_BITS of them here."""
    wanted = max(1, keys.count()) * KEY_BITS
    bits = max(1 << 16, min(MOST_BITS, 1 << (wanted - 1).bit_length()))
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        for batch in batches:
            at = np.concatenate(Filter.places(batch["key"].to_numpy().view(np.uint64), shift))
            at = np.unique(at)
            word = (at >> np.uint64(6)).astype(np.int64)
            mask = np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))[: len(word)]
            if len(word):
                yield pa.record_batch([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(mask, first).view(np.int64))], names=["word", "mask"])

    rows = keys.select("key").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Filter(words)


def _frequent(docs: DataFrame, n: int, support: int, shorter: dict[int, Filter]) -> DataFrame:
    """key: phrases of n words with the lowered support in their shard; shorter are the filters of the levels before."""
    shared = docs.sparkSession.sparkContext.broadcast({k: f.words for k, f in shorter.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        filters = {k: Filter(w) for k, w in shared.value.items()}
        for batch in batches:
            for part in by_bytes(batch):
                for _, chunk in _chunks(part, n):
                    held = None
                    for k in range(2, n):
                        at = np.flatnonzero(chunk.valid[k] if held is None else held[:-1] & held[1:] & chunk.valid[k])
                        held = np.zeros(len(chunk.valid[k]), dtype=bool)
                        held[at[filters[k].holds(chunk.in_shard(k)[at])]] = True
                    here = chunk.counted_here(n)
                    if held is not None:
                        here &= held[:-1] & held[1:]
                    found, times = np.unique(chunk.in_shard(n)[here], return_counts=True)
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(times.astype(np.int32))], names=["key", "times"])

    counts = docs.mapInArrow(run, "key long, times int")
    return counts.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= support).select("key")


def _counted(docs: DataFrame, candidates: Filter) -> DataFrame:
    """(lang, n, phrase, times): all words and the candidate phrases in all documents, by their text."""
    shared = docs.sparkSession.sparkContext.broadcast(candidates.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        wanted = Filter(shared.value)
        for batch in batches:
            held: dict[tuple[str, int], dict[bytes, int]] = {}
            for part in by_bytes(batch):
                for names, chunk in _chunks(part):
                    _exact(names, chunk, wanted, held)
                    if sum(map(len, held.values())) > HELD_PHRASES:
                        yield from _rows(held)
                        held = {}
            yield from _rows(held)

    parts = docs.mapInArrow(run, "lang string, n int, phrase string, times long")
    return parts.groupBy("lang", "n", "phrase").agg(F.sum("times").alias("times"))


def _rows(held: dict[tuple[str, int], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, n), times in held.items():
        columns = [pa.repeat(pa.scalar(lang, pa.string()), len(times)), pa.repeat(pa.scalar(n, pa.int32()), len(times))]
        texts = pa.array(times.keys(), pa.binary()).cast(pa.string())
        yield pa.record_batch([*columns, texts, pa.array(times.values(), pa.int64())], names=["lang", "n", "phrase", "times"])


def _exact(names: list[str], chunk: Chunk, wanted: Filter, held: dict[tuple[str, int], dict[bytes, int]]) -> None:
    """Adds the chunk's words and wanted phrases to what is held, told apart by their text and not by their hash."""

    def add(n: int, first: np.ndarray, times: np.ndarray) -> None:
        some = np.flatnonzero(times)
        owns = [held.setdefault((name, n), {}) for name in names]
        for phrase, lang, k in zip(chunk.texts(first[some], n), chunk.lang[first[some]].tolist(), times[some].tolist()):
            own = owns[lang]
            own[phrase] = own.get(phrase, 0) + k

    words = chunk.numbers()
    many = int(words.max(initial=0)) + 1
    number, inside = chunk.lang * many + words, np.ones(len(words), dtype=bool)
    _, first, place = np.unique(number, return_index=True, return_inverse=True)
    add(1, first, np.bincount(place[chunk.counted_here(1)], minlength=len(first)))
    for n in range(2, LONGEST + 1):
        both = inside[:-1] & inside[1:] & chunk.valid[n]
        at = np.flatnonzero(both)
        at = at[wanted.holds(chunk.keys[n][at] >> np.uint64(3))]
        inside = np.zeros(len(both), dtype=bool)
        inside[at] = True
        # A phrase's number within the chunk is made of that of the phrase without its last word.
        _, first, place = np.unique(number[at] * many + words[at + n - 1], return_index=True, return_inverse=True)
        number = np.full(len(both), -1, dtype=np.int64)
        number[at] = place
        add(n, at[first], np.bincount(place[chunk.counted_here(n)[at]], minlength=len(first)))


def _prepared(docs: DataFrame, text: str, lang: str) -> DataFrame:
    shard = F.pmod(F.xxhash64("doc_id", F.length(utf8(text))), F.lit(SHARDS)).cast("int")
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), utf8(text).alias("text"), shard.alias("shard"))


def counts(docs: DataFrame, support: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n, phrase, times): words and phrases of 2 to LONGEST words with at least `support` occurrences in a language."""
    rows = _prepared(docs, text, lang)
    lowered = math.ceil(support / SHARDS)  # fewer in every shard would make fewer than support
    filters, local = {}, []
    for n in range(2, LONGEST + 1):
        local.append(written(_frequent(rows, n, lowered, filters), "phrases-local"))
        if n < LONGEST:
            filters[n] = filter_of(local[-1])
    union = local[0]
    for other in local[1:]:
        union = union.unionByName(other)
    candidates = filter_of(union.select(F.shiftrightunsigned("key", 3).alias("key")))
    return written(_counted(rows, candidates).where(F.col("times") >= support), "phrases-counted")


def collocations(
    docs: DataFrame, support: int = 30, inside_share: int = 80, most: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The best `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase, of its first part and of the rest at the cut with the lowest score, n those of
    all words of the language; score is floor(2,000,000 a / (l + r)), ties of cuts go to the shortest first part. A phrase is
    dropped where a longer candidate that holds it has inside_share of 100 of its occurrences. Order: score and a descending,
    phrase ascending by its bytes. Null languages count as `und`, null texts as empty; texts without words, too few
    occurrences or an empty table give no rows; repeated rows count as often as they are there.
    """
    found = counts(docs, support, text, lang)
    totals = _prepared(docs, text, lang).groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("n_words"))
    phrases = found.where("n > 1").select("lang", "n", "phrase", F.col("times").alias("a"), F.split("phrase", " ").alias("words"))
    part = found.select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("times").alias("part_times"))

    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("rest"))
    cuts = cuts.join(part, (F.col("lang") == F.col("part_lang")) & (F.col("first") == F.col("part"))).withColumn("l", F.col("part_times")).drop(*part.columns)
    cuts = cuts.join(part, (F.col("lang") == F.col("part_lang")) & (F.col("rest") == F.col("part"))).withColumn("r", F.col("part_times")).drop(*part.columns)
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(20,0))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    sizes = F.expr("sequence(2, n - 1)")
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inner = phrases.where("n > 2").select(F.col("lang").alias("in_lang"), F.explode(F.array_distinct(inner)).alias("in_phrase"), "a")
    inner = inner.groupBy("in_lang", "in_phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    kept = kept.where(F.coalesce(100 * F.col("longer"), F.lit(0)) < inside_share * F.col("a")).select("lang", "phrase", "a", "cut.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    out = kept.join(totals.withColumnRenamed("lang", "total_lang"), F.col("lang") == F.col("total_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
