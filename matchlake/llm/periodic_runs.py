"""Periodic runs of words by maximal pairs.

A run is a stretch of consecutive words with smallest period q, of REPEATS * q words and LEAST words or more, that neither
neighbouring word extends. A pair of places with a common beginning of exactly l words is maximal where the words before
the places differ too. At distance d with l + d at least max(LEAST, REPEATS * d), its stretch of l + d words has period d
and cannot be extended, so it is a run; the least distance of a stretch is its smallest period. And a run of length L
is the maximal pair of its start s and s + q with l = L - q. Nothing has to be extended.

The pairs are read off the tree of common-beginning (LCP) intervals of the sorted suffixes from the leaves up. An interval
holds its places in order, each with its class, the word before it. Places that share l words and lie at most l / 3
apart lie q apart from each other in a row, so the pair of a run is s and the place next to it: when a child joins its
interval, each place of the smaller side looks at its two neighbours on the larger side and at their classes. Suffixes
whose first words do not come again in the document are leaves without an interval that is long enough; they are left
out once that is known, so ordinary text costs two rounds of sorting.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import arrow_rows, no_table, utf8

LEAST, REPEATS = 6, 4
#: Length of a common beginning from which on a pair can be a run: l >= 6 - d and l >= 3 * d, so 5 at least.
SHORTEST = min(max(LEAST - d, (REPEATS - 1) * d) for d in range(1, LEAST + 1))
#: Prefix doubling compares 1, 2, 4, ... words; after this many the suffixes that stand alone are left out.
SIFTED = 1 << (SHORTEST.bit_length() - 1)
#: Fixed value: the six separators as one of them.
SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: Bytes of a text whose words are objects at once, and places in a block of an interval's list.
PART_BYTES = 4 << 20
BLOCK = 2048

RUNS = "array<struct<start:long,length:long,period:long>>"


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    raw, at = raw.translate(SPACES), 0
    while at < len(raw):
        end = raw.find(b" ", at + PART_BYTES) if len(raw) - at > PART_BYTES else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _repeated(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose first SIFTED words come again in their document, in the order of their suffixes, and that order's
    document boundaries: doc is ascending, so documents follow one another."""
    n = len(ids)
    rank = np.zeros(n, dtype=np.int64)
    places, key, width = np.arange(n), doc.astype(np.int64) * (int(ids.max()) + 1) + ids, 1
    sifted = None
    while True:
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        if width == 1:
            ranks = np.repeat(first, np.diff(np.append(first, len(places))))
        else:
            # Places of one former rank lie together: a new group ranks behind the groups before it there.
            old = rank[places]
            began = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), np.arange(len(old)), 0))
            ranks = (old + np.arange(len(old)) - began)[first].repeat(np.diff(np.append(first, len(places))))
        rank[places] = ranks
        alone = new & np.append(new[1:], True)
        places = places[~alone]
        if width == SIFTED:
            sifted = places
        if not len(places):
            break
        after = places + width
        inside = after < ends[doc[places]]
        key = rank[places] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        width *= 2
    if sifted is None:
        sifted = places
    return sifted[np.argsort(rank[sifted], kind="stable")], rank


def _common(order: np.ndarray, ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[int]:
    """Words that each place's suffix has in common with the one before it in the order, 0 across documents.

    In the order of places: a suffix has at least one word less in common than the one a word before it.
    """
    out = np.zeros(len(order), dtype=np.int64)
    by_place = np.argsort(order[1:], kind="stable") + 1
    by_place = by_place[doc[order[by_place]] == doc[order[by_place - 1]]]
    words, lengths, last, h = ids.tolist(), [], -2, 0
    places, others = order[by_place].tolist(), order[by_place - 1].tolist()
    limits = ends[doc[order[by_place]]].tolist()
    for i, j, end in zip(places, others, limits):
        h = h - 1 if i == last + 1 and h > SIFTED else 0
        stop = end - max(i, j)
        while h < stop and words[i + h] == words[j + h]:
            h += 1
        lengths.append(h)
        last = i
    out[by_place] = lengths
    return out.tolist()


_FIRST = itemgetter(0)


def _add(blocks: list[list[int]], x: int) -> None:
    k = max(0, bisect_right(blocks, x, key=_FIRST) - 1)
    block = blocks[k]
    insort(block, x)
    if len(block) > 2 * BLOCK:
        blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]


def _joined(a: tuple[int, list], b: tuple[int, list], l: int, left: list[int], found: dict) -> tuple[int, list]:
    """The places of an interval with l common words and of a further child, as (number, blocks); pairs between them that
    are maximal and near enough go to found."""
    if a[0] < b[0]:
        a, b = b, a
    blocks, far = a[1], l // (REPEATS - 1)
    small = [x for block in b[1] for x in block]
    for x in small:
        k = bisect_right(blocks, x, key=_FIRST) - 1
        if k < 0:
            near = (blocks[0][0],)
        else:
            block = blocks[k]
            j = bisect_right(block, x)
            if j < len(block):
                near = (block[j - 1], block[j])
            else:
                near = (block[-1], blocks[k + 1][0]) if k + 1 < len(blocks) else (block[-1],)
        for y in near:
            d = x - y if x > y else y - x
            if d <= far and l + d >= LEAST and left[x] != left[y]:
                start = min(x, y)
                stretch = (start, start + d + l)
                if d < found.get(stretch, d + 1):
                    found[stretch] = d
    for x in small:
        _add(blocks, x)
    return a[0] + b[0], blocks


def maximal_pairs(order: list[int], common: list[int], left: list[int]) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of every run, from the sorted suffixes, their common beginnings and the classes."""
    found: dict[tuple[int, int], int] = {}
    open_: list[list] = []
    now: tuple[int, list] | None = None
    for x, l in zip(order, common):
        while open_ and open_[-1][0] > l:
            length, held = open_.pop()
            now = _joined(held, now, length, left, found)
        if l >= SHORTEST:
            if open_ and open_[-1][0] == l:
                open_[-1][1] = _joined(open_[-1][1], now, l, left, found)
            else:
                open_.append([l, now])
        now = (1, [[x]])
    while open_:
        length, held = open_.pop()
        now = _joined(held, now, length, left, found)
    return found


def runs_of(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start, then period."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, sizes = [], []
    for raw in texts:
        own = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in _parts(raw)]
        ids += own
        sizes.append(sum(map(len, own)))
    known.clear()
    if not sum(sizes):
        return out
    ids, sizes = np.concatenate(ids), np.array(sizes)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    order, _ = _repeated(ids, doc, ends)
    if len(order) < 2:
        return out
    left = np.concatenate(([-1], ids[:-1]))
    left[(ends - sizes)[sizes > 0]] = -1
    common = _common(order, ids, doc, ends)
    found = maximal_pairs(order.tolist(), common, left.tolist())
    for (start, end), period in found.items():
        d = int(doc[start])
        out[d].append((start - int(ends[d] - sizes[d]), end - start, period))
    return [sorted(x, key=itemgetter(0, 2)) for x in out]


def collapsed(raw: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that lie in a run behind its first period."""
    if not runs:
        return b" ".join(b" ".join(words) for words in _parts(raw) if words)
    first = np.array([s + q for s, _, q in runs])
    after = np.array([s + n for s, n, _ in runs])
    places = np.concatenate((first, after))
    steps = np.concatenate((np.ones(len(first), np.int64), -np.ones(len(after), np.int64)))
    change = np.bincount(places, steps, minlength=int(places.max()) + 1)
    keep, at, out = np.cumsum(change) < 0.5, 0, []
    for words in _parts(raw):
        own = keep[at : at + len(words)].tolist()
        own += [True] * (len(words) - len(own))
        at += len(words)
        left = b" ".join(compress(words, own))
        if left:
            out.append(left)
    return b" ".join(out)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period) and collapsed of every row.

    collapsed is the text's words joined by one space without those that some run contains after its first period. Words
    are runs of anything but the six separators. Null and empty texts have no words: no runs, an empty collapsed text.
    Rows are on their own, so repeated rows and ids, nulls and ties change nothing; an empty table gives no rows. A text is
    handled whole however long it is, at some 100 bytes a word.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        no_table()
        texts = part["text"].cast(pa.binary()).to_pylist()
        runs = runs_of(texts)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        named = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
        short = [collapsed(t, r) for t, r in zip(texts, runs)]
        return pa.record_batch([part["doc_id"], pa.array(named, kind), pa.array(short, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    return arrow_rows(rows, run, f"doc_id long, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """find()'s rows in short: number of runs, the longest one (ties: smallest start, then period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
