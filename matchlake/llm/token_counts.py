"""Token counts of sections: each whole document is encoded once, its tokens are told apart by the characters they cover.

A section ends with a line break, or with the text. Tokens and sections are intervals of the same bytes, so one merge
of their starts finds the section of every token. A token that reaches over a boundary belongs to the section that
RULE names: "first" is the one its first byte is in, "most" the one with most of its bytes, the first of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.bpe import encoder, flat_bytes
from matchlake.llm.common import by_bytes, utf8

#: Bytes of text that are encoded together.
ENCODE_BYTES = 8 << 20
RULES = ("first", "most")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def attribute(token_stops: np.ndarray, section_stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that reach over a boundary. Both are given by where each ends."""
    starts = np.concatenate(([0], token_stops[:-1])) if len(token_stops) else token_stops
    first = np.searchsorted(section_stops, starts, side="right")
    last = np.searchsorted(section_stops, token_stops - 1, side="right")
    owner, across = first.copy(), np.flatnonzero(last > first)
    if rule == "most":
        for t in across.tolist():  # few tokens reach over a boundary
            edges = np.concatenate(([starts[t]], section_stops[first[t] : last[t]], [token_stops[t]]))
            owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    n = len(section_stops)
    return np.bincount(owner, minlength=n), np.bincount(owner[across], minlength=n)


def count(docs: DataFrame, tokenizer: str, rule: str = "first", text: str = "text") -> DataFrame:
    """One row for each section of each row: where it starts and ends in code points, its tokens, those across a boundary.

    A null text counts as empty; an empty text is one section without tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, ENCODE_BYTES):
                ids, _ = bpe.encode_flat(part["text"])
                raw, at = flat_bytes(part["text"])
                stops = np.unique(np.concatenate((np.flatnonzero(raw == 10) + 1, at[1:])))
                stops = stops[stops > 0]
                tokens, crossing = attribute(np.cumsum(bpe.token_bytes[ids]), stops, rule)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                rows = np.searchsorted(at[1:], stops, side="left")  # the document each section ends in
                empty = np.flatnonzero(np.diff(at) == 0)
                rows, full = np.concatenate((rows, empty)), len(stops)
                pad = lambda x: np.concatenate((x, np.zeros(len(empty), dtype=np.int64)))
                begin = np.concatenate(([0], stops[:-1])) if full else stops
                base = points[at[:-1]][rows[:full]]
                number = np.arange(full) - np.searchsorted(rows[:full], rows[:full], side="left")
                yield pa.record_batch(
                    [part["doc_id"].take(pa.array(rows)), pa.array(pad(number).astype(np.int32)), *[pa.array(pad(x).astype(np.int64)) for x in (points[begin] - base, points[stops] - base, tokens, crossing)]],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
