"""Byte-level BPE of whole texts with the tokenizers library.

The pre-tokenizer of the vocabulary never joins a space to what stands before it, unless that is white space as well.
So a text may be cut in front of such spaces, each piece encoded by itself, and the ids put together. Pieces repeat,
so a bounded table of encoded pieces saves most of the work; what is not in it is encoded by the library in one batch.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from matchlake.llm.common import worker_table

#: Encoded pieces that a worker keeps; beyond it the table starts anew.
KEPT_PIECES = 1_000_000
#: White space other than the space itself. A space beside one of these, or beside another space, is no cut.
OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_BESIDE = tuple(f" {c}" for c in OTHER_SPACE)
_ODD = f"^ | $|  | [{OTHER_SPACE}]"


class _Places(dict):
    """Place of each piece in the table of encoded pieces; a new piece gets the next one and is noted.

    A piece that is a space and a word is known by its word, any other by its text and a space.
    """

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        self.new.append(key)
        return place


class PieceTable:
    """Ids of the pieces seen so far, one after another, and what stands at which place."""

    kept = KEPT_PIECES

    def _empty(self) -> None:
        self.places = _Places()
        self.ids, self.stops = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def make_room(self) -> None:
        if len(self.places) > self.kept:
            self._empty()

    def place(self, keys: list[str] | np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))

    def direct(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces one after another, and the number of ids of each."""
        raise NotImplementedError

    def ids_at(self, places: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose pieces are at these places, as many as of says for each, and the number of ids of each."""
        if new := self.places.new:
            ids, counts = self.direct(new)
            self.stops = np.concatenate((self.stops, len(self.ids) + np.cumsum(counts)))
            self.ids = np.concatenate((self.ids, ids))
            self.places.new = []
        stops = self.stops[places]
        counts = stops - np.where(places > 0, self.stops[places - 1], 0)
        ends = np.cumsum(counts)
        picked = np.repeat(stops - ends, counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[picked], np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(of)))])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts one after another, and where each begins and the last ends. No text is null."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


class Encoder(PieceTable):
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._empty()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def direct(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library.

        Pieces that begin with a space before other text may stand side by side, so they go in as long texts and their
        ids are told apart by the bytes they cover.
        """
        pieces = [k[:-1] if " " in k else " " + k for k in keys]
        spaced = [len(p) > 1 and p[0] == " " and p[1] != " " and p[1] not in OTHER_SPACE for p in pieces]
        texts, counts, at = [], [], 0
        while at < len(pieces):
            stop = at + 1
            if spaced[at]:
                while stop < len(pieces) and stop - at < 4096 and spaced[stop]:
                    stop += 1
            texts.append((at, stop))
            at = stop
        found = self._library(["".join(pieces[a:b]) for a, b in texts])
        for (a, b), ids in zip(texts, found):
            if b - a == 1:
                counts.append([len(ids)])
            else:
                ends = np.cumsum([len(p.encode()) for p in pieces[a:b]])
                counts.append(np.diff(np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1, prepend=0))
        return np.concatenate(found), np.concatenate(counts).astype(np.int64)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut in front of spaces; put together they are the text."""
        first, *rest = text.split(" ")
        out = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        if not (" " in out or any(x in text for x in _BESIDE)):
            return out
        joined = out[:1]  # a space before white space, or at the end, stays with what is before it
        for piece in out[1:]:
            if len(piece) == 1 or piece[1] in OTHER_SPACE or joined[-1][-1] == " ":
                joined[-1] += piece
            else:
                joined.append(piece)
        return joined

    def _odd(self, text: str) -> np.ndarray:
        """Places of the pieces of a text that is not just words with single spaces between."""
        return self.place([p[1:] if p[0] == " " and len(p) > 1 and " " not in p[1:] else p + " " for p in self.pieces(text)])

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each.

        Words are told apart in Arrow, so that only the distinct ones of the texts in hand are looked up.
        """
        self.make_room()
        texts = texts.fill_null("")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0))
        rest = np.delete(np.arange(len(texts)), odd)
        split = pc.split_pattern(texts.take(pa.array(rest)) if len(odd) else texts, " ")
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        words = split.flatten()
        coded = words.dictionary_encode()
        flat = self.place(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
        first = np.cumsum(sizes) - sizes  # the first word of a text has no space before it
        if len(first):
            flat[first] = self.place([w + " " for w in words.take(pa.array(first)).to_pylist()])
        of = np.zeros(len(texts), dtype=np.int64)
        of[rest] = sizes
        if len(odd):
            rows = np.split(flat, np.cumsum(sizes)[:-1]) if len(rest) else []
            whole = dict(zip(rest.tolist(), rows)) | {i: self._odd(texts[i].as_py()) if len(texts[i].as_py()) else flat[:0] for i in odd.tolist()}
            of[odd] = [len(whole[i]) for i in odd.tolist()]
            flat = np.concatenate([whole[i] for i in range(len(texts))])
        return self.ids_at(flat, of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []

    @property
    def token_bytes(self) -> np.ndarray:
        """Bytes of text behind each id: the vocabulary writes each byte as one character."""
        if not hasattr(self, "_bytes"):
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self._bytes = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
            self._bytes[list(vocab.values())] = [len(k) for k in vocab]
        return self._bytes


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary."""
    return worker_table(("bpe", path), lambda: Encoder(path))
