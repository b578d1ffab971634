"""SentencePiece encoding and decoding by a Viterbi search that common beginnings of words share.

Every word is marked with the space before it; of a run of spaces all go with the word that follows, or make up a word of
their own at the end of a text. The distinct marked words of the texts in hand are sorted, which lays them out as a trie in depth-first order: what a word has in common with the one before it keeps its forward scores, its
back pointers and the pieces still open there, and only the rest is searched. The best path of a word is the one of
the largest sum of the vocabulary's scores, ties to the longer last piece. No piece has a mark after another character,
a vocabulary with such a piece is refused, so the best paths of the words make up the best path of the text. Characters that no piece covers become bytes. Decoding gives back
every text exactly; a U+2581 that is in a text is written as bytes, since as a piece it stands for a space.

The vocabulary may be of either kind. Scores of a BPE file are ranks of merges: the search then gives the path of the
best ranks, which is not the order of merges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.bpe import KEPT_PIECES, PieceTable, flat_bytes
from matchlake.llm.common import by_bytes, utf8, worker_table

MARK = "▁"
#: Fixed value: what an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of text whose words are searched together.
ENCODE_BYTES = 1 << 20


class Lattice:
    """Forward scores along one path of the words' trie, for words that come in sorted order."""

    def __init__(self, scores: dict[str, tuple[int, float]], worst: float):
        self.unknown = worst - UNKNOWN_PENALTY
        self.root: dict = {}
        for piece, entry in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = entry
        self.inner = {c: n for c, n in self.root.items() if c != MARK}  # what may begin after a word's own mark

    def paths(self, words: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        """Start, end and piece, or -1, along the best path of each of the sorted words."""
        score, back = [0.0], [(0, -1)]
        open_: list[list[tuple[int, dict]]] = [[]]
        before = ""
        for word in words:
            kept, most = 0, min(len(before), len(word))
            while kept < most and before[kept] == word[kept]:
                kept += 1
            del score[kept + 1 :], back[kept + 1 :], open_[kept + 1 :]
            for at in range(kept, len(word)):
                c, still, best, step, alone = word[at], [], None, None, False
                for start, node in (*open_[at], (at, self.inner if at else self.root)):
                    node = node.get(c)
                    if node is None:
                        continue
                    still.append((start, node))
                    if None in node:
                        piece, value = node[None]
                        alone = alone or start == at
                        value += score[start]
                        if best is None or value > best:
                            best, step = value, (start, piece)
                if not alone and (best is None or score[at] + self.unknown > best):
                    best, step = score[at] + self.unknown, (at, -1)
                score.append(best)
                back.append(step)
                open_.append(still)
            before, end, path = word, len(word), []
            while end:
                start, piece = back[end]
                path.append((start, end, piece))
                end = start
            yield path[::-1]


class Pieces(PieceTable):
    """Ids of texts by the lattice, and texts of ids."""

    kept = KEPT_PIECES // 5

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_ids, scores, worst = np.zeros(256, dtype=np.int64), {}, 0.0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                worst = min(worst, model.get_score(i))
                word = piece.lstrip(MARK)
                if MARK in word:
                    raise ValueError(f"a piece reaches from one word into the next: {piece}")
                # A word's own mark is its first character, further spaces before it stay spaces.
                spaces = len(piece) - len(word)
                scores[MARK * (spaces > 0) + " " * (spaces - 1) + word] = entry = (i, model.get_score(i))
                scores[" " * spaces + word] = entry
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if (self.byte_ids == 0).any():
            raise ValueError("the vocabulary has no pieces for all bytes")
        self.lattice = Lattice(scores, worst)
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.piece_sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.piece_stops = np.cumsum(self.piece_sizes)
        self._empty()

    def direct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], np.zeros(len(words), dtype=np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        spans = [0] * len(words)
        for n, path in zip(order, self.lattice.paths([MARK + words[n] for n in order])):
            begin = len(ids)
            for start, end, piece in path:
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += self.byte_ids[list((MARK + words[n])[start:end].encode())].tolist()
            counts[n], spans[n] = len(ids) - begin, begin
        flat = np.array(ids, dtype="<u4")
        ends = np.cumsum(counts)
        return flat[np.repeat(np.array(spans, dtype=np.int64) - (ends - counts), counts) + np.arange(len(ids))], counts

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each; an empty text has none."""
        self.make_room()
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        of = pc.list_value_length(split).to_numpy().astype(np.int64)
        empty = pc.binary_length(texts).to_numpy() == 0
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        spaces = np.zeros(len(at), dtype=np.int64)
        if (none := np.flatnonzero(words == "")).size:
            # Nothing between two spaces: the first of them goes on with the next word of the text, or with its end.
            last = np.zeros(len(at), dtype=bool)
            last[np.cumsum(of) - 1] = True
            kept = np.flatnonzero((at != none[0]) | last)
            at, spaces = at[kept], np.diff(kept, prepend=-1) - 1
            of = np.diff(np.searchsorted(kept, np.concatenate(([0], np.cumsum(of)))))
        runs, of_run = np.unique(np.column_stack((at, spaces))[spaces > 0], axis=0, return_inverse=True)
        single = np.zeros(len(words), dtype=bool)
        single[at[spaces == 0]] = True
        places = np.zeros(len(words), dtype=np.int64)
        places[single] = self.place(words[single])
        flat = places[at]
        flat[spaces > 0] = self.place([" " * n + words[w] for w, n in runs.tolist()])[of_run.ravel()]
        if empty.any():
            flat = flat[~np.repeat(empty, of)]
            of = np.where(empty, 0, of)
        return self.ids_at(flat, of)

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts one after another, each with the space that its first mark stands for, and where each ends."""
        sizes = self.piece_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.repeat(self.piece_stops[ids] - ends, sizes) + np.arange(total)]
        return raw, np.concatenate(([0], ends))[np.cumsum(counts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode()[1:]


def pieces(path: str) -> Pieces:
    """The worker's table for a vocabulary."""
    return worker_table(("pieces", path), lambda: Pieces(path))


def _encoded(model: str, texts: pa.Array):
    table = pieces(model)
    ids, counts = table.encode_flat(texts)
    ends = np.cumsum(counts)
    raw, stops = table.decode_flat(ids, counts)
    held, at = flat_bytes(texts)
    exact = []
    for n, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist())):
        begin = (int(stops[n - 1]) if n else 0) + (1 if count else 0)
        exact.append(np.array_equal(raw[begin:stop], held[at[n] : at[n + 1]]))
    return ids, counts, ends, exact


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id, pieces, CRC of the ids as little-endian 32-bit integers, and whether they decode to the text itself.

    A null text counts as empty, an empty one has no pieces; one row for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, ENCODE_BYTES):
                ids, counts, ends, exact = _encoded(model, part["text"])
                sums = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.record_batch([part["doc_id"], pa.array(counts), pa.array(sums, pa.int64()), pa.array(exact)], names=["doc_id", "n_pieces", "ids_crc32", "exact"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, exact boolean")


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key of each row with its ids, their number, and whether they decode to the text itself; null texts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, ENCODE_BYTES):
                ids, counts, ends, exact = _encoded(model, part["text"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.record_batch([part[key], lists, pa.array(counts), pa.array(exact)], names=[key, "ids", "n_pieces", "exact"])

    rows = docs.select(F.col(key).cast("long").alias(key), utf8(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, ids array<int>, n_pieces long, exact boolean")


def decode(rows: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The key of each row with the text of its ids; null ids as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            yield pa.record_batch([batch[key], pa.array([table.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], names=[key, "text"])

    some = rows.select(F.col(key).cast("long").alias(key), F.col(ids).alias("ids"))
    return some.mapInArrow(run, f"`{key}` long, text string")
