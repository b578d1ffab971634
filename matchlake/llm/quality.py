"""Quality of documents by co-training: one classifier sees the text, the other what is known of its page.

The text view holds hashed words and runs of four bytes of the whole text, the shapes of its words and lines. The page view
holds language, source, both together, and the page's size as the table states it.

Both views start from labelled documents. In each round all unlabelled documents are scored by both; histograms of the scores
over all of them say from where on a view is sure enough of as many documents as the round hands over, and those become
examples of the other view. A fit reads a bounded number of them, spread over the other view's scores so that documents it
knows nothing of are among them, however rare; each weighs as the square root of the number it stands for. At the end each view is calibrated on labelled
documents that no round trained on, and the same documents weigh the views' log odds into one.

Fits run in one task on rows whose number is bounded; the driver holds weights, histograms and nothing of the documents.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_bytes, no_table, utf8, written

#: Bounds of a fit: labelled documents, those with the smallest hashes of their ids, and about so many of the documents that
#: one view hands to the other in a round, for each class. All others are scored, and counted in every histogram.
LABELLED_ROWS = 4000
PSEUDO_ROWS = 600
ROUNDS = 2
#: Documents of each class that a view hands over in the first round, of each 1000 unlabelled ones; in the second round twice as
#: many. And how sure it has to be.
HANDED_OVER = 100
SURE = 0.95
#: Places of the text view's shapes, hash buckets of its words and of its runs of GRAM bytes; those of the page view.
SHAPE_DIMS, WORD_DIMS, GRAM_DIMS = 256, 2048, 2048
GRAM = 4
VIEW_DIMS = SHAPE_DIMS + WORD_DIMS + GRAM_DIMS
NAME_DIMS, PAIR_DIMS, SIZE_DIMS = 32, 64, 24
PAGE_DIMS = 2 * NAME_DIMS + PAIR_DIMS + SIZE_DIMS
#: Fixed value: scale of the word and run features, in place of one by their spread; with the ridge it bounds their weights.
HASH_SCALE = 4.0
#: Texts and bytes of a part, of which a longer text comes in several, whose counts add up; bytes of parts that are laid out at
#: once, for each of which some 60 are held.
STEP_ROWS, PART_BYTES, JOINT_BYTES = 512, 4 << 20, 1 << 19
#: A document is kept unless its score is below; set on held-out labels, see _finished().
KEEP_GOOD = 0.998
#: Log odds are cut into bins of a histogram: BINS of WIDTH around 0, and the other view's into as many groups as SPREAD has, plus one.
BINS, WIDTH = 240, 0.1
SPREAD = (-3.0, -1.0, 1.0, 3.0)

#: Kinds of bytes: letters and bytes beyond ASCII, digits, capitals, blanks, line ends, each mark by itself.
_SHAPE = np.full(256, 1, dtype=np.uint8)
_SHAPE[list(b"0123456789")] = 2
_SHAPE[list(range(65, 91))] = 3
_SHAPE[list(b" \t\x0b\x0c\r")] = 4
_SHAPE[10] = 5
for _i, _b in enumerate(b".,;:!?|#$%&*'\"-_/\\()[]{}<>=+@~^`"):
    _SHAPE[_b] = 6 + _i
CLASSES = 6 + 33
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SUMS = 17
_PAIRS = SHAPE_DIMS - CLASSES - _SUMS
_CELL = ((np.arange(4096, dtype=np.int64) * 2654435761 >> 7) % _PAIRS).astype(np.int64)
_CUT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(low: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the first and last eight bytes and the length of each word; low has eight bytes behind the last word."""
    eight = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))
    cut = _CUT[np.minimum(ends - begins, 8)]
    return _mixed((eight[begins] & cut) * _C1 + (eight[np.maximum(ends - 8, begins)] & cut) * _C2 + (ends - begins).astype(np.uint64))


def _counts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each part its sums (bytes, words, lines, kinds, pairs of kinds) and its counts by hash bucket."""
    n, text = len(parts), b"".join(parts)
    size = len(text)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    raw, row = np.frombuffer(text, np.uint8), np.repeat(np.arange(n), sizes)
    shape = _SHAPE[raw]
    sums, hashed = np.zeros((n, SHAPE_DIMS)), np.zeros((n, WORD_DIMS + GRAM_DIMS))
    by_row = lambda at, values=None: np.bincount(at, values, minlength=n)
    full = sizes > 0
    space = (shape == 4) | (shape == 5)
    edge = np.ones(size + 1, dtype=bool)
    edge[1:-1] = space[:-1]
    edge[starts[full]] = True
    begins = np.flatnonzero(~space & edge[:-1])
    edge[1:-1] = space[1:]
    edge[stops[full]] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    low = text.translate(_LOWER) + bytes(8)
    words, own = word_hashes(low, begins, ends), row[begins]
    sums[:, 0] = sizes
    if len(begins):
        within = lambda x: np.add.reduceat(x.astype(np.int32), begins)
        _, first = np.unique(_mixed(words + own.astype(np.uint64) * _C3), return_index=True)
        same = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
        sums[:, 1], sums[:, 2], sums[:, 3] = by_row(own), by_row(own[first]), by_row(own[1:][same])
        sums[:, 4] = by_row(own, ends - begins)
        sums[:, 5], sums[:, 6] = by_row(own[within(shape >= 6) >= 2]), by_row(own[within(shape == 3) >= 2])
        sums[:, 7] = by_row(own[(ends - begins == 1) & (shape[begins] >= 6)])
        at = own * WORD_DIMS + (words >> np.uint64(20)).astype(np.int64) % WORD_DIMS
        hashed[:, :WORD_DIMS] = np.bincount(at, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    if size >= GRAM:
        four = np.ndarray((size - GRAM + 1,), "<u4", buffer=low, strides=(1,))
        at = row[: 1 - GRAM] * GRAM_DIMS + ((four * np.uint32(2654435761)) >> np.uint32(21))
        at = at[row[: 1 - GRAM] == row[GRAM - 1 :]]
        hashed[:, WORD_DIMS:] = np.bincount(at, minlength=n * GRAM_DIMS).reshape(n, GRAM_DIMS)
    # Lines: each part has one more than line ends.
    marks = np.flatnonzero(shape == 5)
    line_row = np.concatenate((np.arange(n), row[marks]))
    order = np.argsort(line_row, kind="stable")
    line_row = line_row[order]
    line = np.concatenate((starts, marks + 1))[order]
    order = np.argsort(np.concatenate((row[marks], np.arange(n))), kind="stable")
    stop = np.concatenate((marks, stops))[order]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words)))
    says = total[np.searchsorted(begins, stop)] - total[np.searchsorted(begins, line)]
    _, first = np.unique(_mixed(says + line_row.astype(np.uint64) * _C3), return_index=True)
    long = stop - line
    some = long > 0
    sums[:, 8], sums[:, 9], sums[:, 10] = by_row(line_row), by_row(line_row, long), by_row(line_row, long.astype(float) ** 2)
    sums[:, 11], sums[:, 12] = np.maximum.reduceat(long, np.searchsorted(line_row, np.arange(n))), by_row(line_row[first])
    closed = np.isin(raw[stop[some] - 1], list(b".!?"))
    sums[:, 13], sums[:, 14] = by_row(line_row[some][closed]), by_row(line_row[some][shape[line[some]] == 3])
    sums[:, 15], sums[:, 16] = by_row(row[raw == 32]), by_row(row[raw >= 128])
    kinds = np.bincount(row * 64 + shape, minlength=n * 64).reshape(n, 64)
    sums[:, _SUMS : _SUMS + CLASSES] = kinds[:, :CLASSES]
    pairs = np.flatnonzero(((shape[:-1] != 1) | (shape[1:] != 1)) & (row[:-1] == row[1:]))
    cell = _CELL[shape[pairs].astype(np.int64) * 64 + shape[pairs + 1]]
    sums[:, _SUMS + CLASSES :] = np.bincount(row[pairs] * _PAIRS + cell, minlength=n * _PAIRS).reshape(n, _PAIRS)
    return sums, hashed


def text_features(texts: list[bytes]) -> np.ndarray:
    """Rows of the text view, at most STEP_ROWS: shares and rates of the sums, square roots of the shares of words and runs.

    Distinct words and lines are counted within parts of PART_BYTES.
    """
    parts, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t) if len(t) - at <= PART_BYTES else t.rfind(b" ", at + 1, at + PART_BYTES)
            end = at + PART_BYTES if end < 0 else end
            parts.append(t[at:end])
            owner.append(i)
            at = end
            if at >= len(t):
                break
    n = len(texts)
    sums, hashed, most = np.zeros((n, SHAPE_DIMS)), np.zeros((n, WORD_DIMS + GRAM_DIMS)), np.zeros(n)
    first = 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (last == first or size + len(parts[last]) <= JOINT_BYTES):
            size += len(parts[last])
            last += 1
        s, h = _counts(parts[first:last])
        own = np.array(owner[first:last])
        np.maximum.at(most, own, s[:, 11])
        if len(set(owner[first:last])) == len(own) and own[0] == own[-1] - len(own) + 1:
            sums[own[0] : own[-1] + 1] += s
            hashed[own[0] : own[-1] + 1] += h
        else:
            np.add.at(sums, own, s)
            np.add.at(hashed, own, h)
        first = last
    sums[:, 11] = most
    out = np.empty((n, VIEW_DIMS), dtype=np.float32)
    size, words, lines = (np.maximum(sums[:, i], 1) for i in (0, 1, 8))
    mean = sums[:, 9] / lines
    out[:, :_SUMS] = np.column_stack((
        np.log1p(sums[:, 0]) / 10, np.log1p(sums[:, 1]) / 10, sums[:, 2] / words, sums[:, 3] / words, np.minimum(sums[:, 4] / words / 20, 2.0),
        sums[:, 5] / words, sums[:, 6] / words, sums[:, 7] / words, np.log1p(lines) / 5, np.log1p(mean) / 8,
        np.log1p(np.sqrt(np.maximum(sums[:, 10] / lines - mean**2, 0))) / 10, np.log1p(sums[:, 11]) / 10, sums[:, 12] / lines, sums[:, 13] / lines,
        sums[:, 14] / lines, sums[:, 15] / size, sums[:, 16] / size,
    ))
    out[:, _SUMS:SHAPE_DIMS] = np.sqrt(sums[:, _SUMS:] / size[:, None])
    out[:, SHAPE_DIMS : SHAPE_DIMS + WORD_DIMS] = np.sqrt(hashed[:, :WORD_DIMS] / words[:, None])
    out[:, SHAPE_DIMS + WORD_DIMS :] = np.sqrt(hashed[:, WORD_DIMS:] / np.maximum(size - GRAM + 1, 1)[:, None])
    return out


def page_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Rows of the page view: places of language, source and both by hash, and of the size by powers of two."""
    out = np.zeros((len(langs), PAGE_DIMS), dtype=np.float32)
    for row, lang, source, size in zip(out, langs, sources, sizes):
        a, b = (lang or "").encode(), (source or "").encode()
        row[zlib.crc32(a) % NAME_DIMS] = 0.5
        row[NAME_DIMS + zlib.crc32(b) % NAME_DIMS] = 0.5
        row[2 * NAME_DIMS + zlib.crc32(a + b"\0" + b) % PAIR_DIMS] = 0.5
        row[2 * NAME_DIMS + PAIR_DIMS + (0 if size is None else min(max(0, size).bit_length() + 1, SIZE_DIMS - 1))] = 0.5
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Linear:
    """Log odds as a weighted sum of features."""

    weights: np.ndarray
    shift: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.shift, -30, 30)


def _newton(z: np.ndarray, target: np.ndarray, share: np.ndarray, penalty: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """Weights of least penalised log loss; a step that does not lower it is halved."""

    def by_row(w: np.ndarray) -> np.ndarray:
        return (z @ w.astype(z.dtype)).astype(np.float64)

    def by_column(v: np.ndarray) -> np.ndarray:
        return (v.astype(z.dtype) @ z).astype(np.float64)

    def step_of(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """The Newton step: solved as it is for few weights, for many by conjugate gradients, which need products only."""
        if len(slope) <= 512:
            return np.linalg.solve(((z * bend[:, None]).T @ z).astype(np.float64) + np.diag(penalty), slope)
        diagonal = np.concatenate([bend @ (z[:, i : i + 256].astype(np.float64) ** 2) for i in range(0, z.shape[1], 256)]) + penalty
        x, r = np.zeros_like(slope), slope.copy()
        d = r / diagonal
        q = r @ d
        for _ in range(60):
            if np.sqrt(r @ r) <= 1e-3 * np.sqrt(slope @ slope):
                break
            h = by_column(by_row(d) * bend) + penalty * d
            size = q / (d @ h)
            x, r = x + size * d, r - size * h
            y = r / diagonal
            q, before = r @ y, q
            d = y + q / before * d
        return x

    def loss(w: np.ndarray) -> float:
        m = by_row(w)
        return float((share * (np.logaddexp(0, m) - target * m)).sum() + 0.5 * (penalty * (w - start) ** 2).sum())

    w, now = start.copy(), loss(start)
    for _ in range(steps):
        slope = by_column(share * (_sigmoid(by_row(w)) - target)) + penalty * (w - start)
        if not np.abs(slope).max() > 1e-9:
            break
        p = _sigmoid(by_row(w))
        step, size = step_of(slope, share * p * (1 - p)), 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-3:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-4 * before:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Linear:
    """Logistic regression on scaled features, where the classes weigh the same and rows as given within their class."""
    d = x.shape[1]
    mean, scale = np.zeros(d), np.full(d, 4.0 if d == PAGE_DIMS else HASH_SCALE)
    own = SHAPE_DIMS if d == VIEW_DIMS else 0 if d == PAGE_DIMS else d
    if own:
        mean[:own] = x[:, :own].mean(axis=0, dtype=np.float64)
        scale[:own] = 1 / np.maximum(x[:, :own].std(axis=0, dtype=np.float64), 0.02)
    z = np.ones((len(x), d + 1), dtype=np.float32 if d == VIEW_DIMS else np.float64)
    for i in range(0, len(x), 256):
        z[i : i + 256, :-1] = (x[i : i + 256] - mean) * scale
    share = np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum())) * weight * len(y)
    w = _newton(z, y, share, ridge * np.append(np.ones(d), 1e-6), np.zeros(d + 1), 10)
    return Linear((scale * w[:-1]).astype(np.float64), float(w[-1] - mean @ (scale * w[:-1])))


def calibrated(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of log odds, none below 0, and a shift, that make the odds those of held-out labels."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    out, used = np.zeros(raw.shape[1] + 1), list(range(raw.shape[1]))
    while True:
        z = np.column_stack((raw[:, used], np.ones(len(raw))))
        start = np.append(np.full(len(used), 1 / max(1, len(used))), 0.0)
        w = _newton(z, target, np.ones(len(y)), np.full(len(start), 1.0), start, 50)
        wrong = [u for u, v in zip(used, w) if v < 0]
        if not wrong:
            break
        used = [u for u in used if u not in wrong]  # a view that says the opposite says nothing; the rest is fitted anew
    out[used], out[-1] = w[:-1], w[-1]
    return out


@dataclass(frozen=True)
class Views:
    """Both classifiers, what calibrates and joins them, and the log odds from which on a document is kept."""

    text: Linear
    page: Linear
    by_text: np.ndarray
    by_page: np.ndarray
    joint: np.ndarray
    keep_from: float

    def logits(self, t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.column_stack((t, p)) @ self.joint[:2] + self.joint[2]
        return both, t * self.by_text[0] + self.by_text[1], p * self.by_page[0] + self.by_page[1]


def _keep_all() -> Views:
    return Views(Linear(np.zeros(VIEW_DIMS), 0.0), Linear(np.zeros(PAGE_DIMS), 0.0), np.zeros(2), np.zeros(2), np.zeros(3), 0.0)


def _fitted(rows: pa.Table) -> Views:
    """Both views from rows (key, taker, label, weight, xt, xp); the views' calibration from each third labelled row.

    taker is empty for labelled documents, else the view that the row was handed to. The rows handed over weigh as much as the
    labelled ones at most.
    """
    # The features stay as they came; what is sorted is their places.
    narrow = rows.select(["key", "taker", "label", "weight"]).append_column("place", pa.array(np.arange(rows.num_rows)))
    narrow = narrow.sort_by([("taker", "ascending"), ("key", "ascending"), ("label", "ascending")])
    place_of = narrow["place"].to_numpy()
    taker, y = np.array(narrow["taker"].to_pylist(), dtype=object), narrow["label"].to_numpy().astype(float)
    weight = narrow["weight"].to_numpy().astype(float).copy()
    labelled = taker == ""
    place = np.cumsum(labelled) - 1
    held = labelled & (place % 3 == 2)
    if len(set(y[labelled])) < 2:
        return _keep_all()
    if len(set(y[held])) < 2 or len(set(y[labelled & ~held])) < 2:
        held[:] = False
    check = held if held.any() else labelled
    xp = np.vstack([np.frombuffer(x, np.float32) for x in rows["xp"].to_pylist()])[place_of]
    models = {}
    for view in ("text", "page"):
        train = (labelled & ~held) | (taker == view)
        given = taker == view
        if given.any():
            weight[given] *= min(1.0, (labelled & ~held).sum() / weight[given].sum())
        x = xp[train] if view == "page" else _dense(rows["xt"], place_of[train])
        models[view] = logistic(x, y[train], weight[train])
        del x
    t, p = models["text"].logit(_dense(rows["xt"], place_of[check]))[:, None], models["page"].logit(xp[check])[:, None]
    return _finished(models["text"], models["page"], t, p, y[check])


def _finished(text: Linear, page: Linear, t: np.ndarray, p: np.ndarray, y: np.ndarray) -> Views:
    views = Views(text, page, calibrated(t, y), calibrated(p, y), calibrated(np.hstack((t, p)), y), 0.0)
    score = np.sort(views.logits(t[:, 0], p[:, 0])[0][y == 1])
    # Nearly all good held-out documents stay, and so does a document that is more likely good than not.
    lowest = float(score[int((1 - KEEP_GOOD) * len(score))]) if len(score) else 0.0
    return replace(views, keep_from=min(0.0, lowest))


def _packed(x: np.ndarray) -> bytes:
    """A row of the text view: shapes, then places and values of the buckets that are not empty."""
    at = np.flatnonzero(x[SHAPE_DIMS:]).astype(np.uint16)
    return x[:SHAPE_DIMS].tobytes() + at.tobytes() + x[SHAPE_DIMS + at.astype(np.int64)].tobytes()


def _dense(rows: pa.ChunkedArray, some: np.ndarray) -> np.ndarray:
    out = np.zeros((len(some), VIEW_DIMS), dtype=np.float32)
    for row, i in zip(out, some.tolist()):
        x = rows[i].as_py()
        n = (len(x) - 4 * SHAPE_DIMS) // 6
        row[:SHAPE_DIMS] = np.frombuffer(x, np.float32, SHAPE_DIMS)
        row[SHAPE_DIMS + np.frombuffer(x, np.uint16, n, 4 * SHAPE_DIMS).astype(np.int64)] = np.frombuffer(x[4 * SHAPE_DIMS + 2 * n :], np.float32)
    return out


def _inputs(docs: DataFrame, text: str) -> DataFrame:
    """Columns that the views read, under their own names; tables without them have nulls there."""
    kinds = {"doc_id": "long", "lang": "string", "source": "string", "n_chars": "long"}
    columns = [(F.col(f"`{c}`").try_cast(t) if c in docs.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]
    return docs.select(utf8(text).alias("text"), *columns)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their rows of both views."""
    no_table()
    for batch in batches:
        for part in by_bytes(batch):
            for i in range(0, part.num_rows, STEP_ROWS):
                step = part.slice(i, STEP_ROWS)
                xp = page_features(*(step[c].to_pylist() for c in ("lang", "source", "n_chars")))
                yield step, text_features(step["text"].cast(pa.binary()).to_pylist()), xp


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step, xt, xp in _steps(batches):
        columns = [pa.array([_packed(x) for x in xt], pa.binary()), pa.array([x.tobytes() for x in xp], pa.binary())]
        yield pa.record_batch([*(step[c] for c in ("key", "taker", "label", "weight")), *columns], names=["key", "taker", "label", "weight", "xt", "xp"])


EXAMPLE = "key long, taker string, label int, weight double, xt binary, xp binary"


def _examples_of(docs: DataFrame, chosen: DataFrame, on: str) -> DataFrame:
    """Rows of a fit: of each key of chosen (on, taker, label, weight) one of docs' rows, that of the smallest text hash."""
    rows = docs.join(F.broadcast(chosen), on)  # LABELLED_ROWS or about 4 * PSEUDO_ROWS narrow rows
    one = F.min_by(F.struct("text", "lang", "source", "n_chars"), F.xxhash64("text", "lang", "source", "n_chars"))
    rows = rows.groupBy(F.col(on).alias("key"), "taker", "label", "weight").agg(one.alias("one"))
    return rows.select("key", "taker", "label", "weight", "one.*").mapInArrow(_examples, EXAMPLE)


def _fit_in_a_task(examples: DataFrame) -> Views:
    """The fit runs where its bounded number of rows is brought together; weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        held = list(batches)
        views = _fitted(pa.Table.from_batches(held)) if sum(b.num_rows for b in held) else _keep_all()
        yield pa.record_batch([pa.array([pickle.dumps(views)], pa.binary())], names=["views"])

    found = examples.repartition(1).mapInArrow(run, "views binary").collect()
    return pickle.loads(found[0]["views"]) if found else _keep_all()


def _scored(docs: DataFrame, text: Linear, page: Linear) -> DataFrame:
    """(doc_id, h, t, p): log odds of both views for every row; h is a hash of all that the views read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, xt, xp in _steps(batches):
            logits = [pa.array(m.logit(x).astype(np.float32)) for m, x in ((text, xt), (page, xp))]
            yield pa.record_batch([step["doc_id"], step["h"], *logits], names=["doc_id", "h", "t", "p"])

    rows = docs.withColumn("h", F.xxhash64("text", "lang", "source", "n_chars"))
    return rows.mapInArrow(run, "doc_id long, h long, t float, p float")


def _bin(x):
    """Whole number of a log odds' bin, 0 to BINS - 1."""
    return F.least(F.greatest(F.floor(x / WIDTH).cast("int") + BINS // 2, F.lit(0)), F.lit(BINS - 1))


def _group(x):
    return sum(((x >= e).cast("int") for e in SPREAD), F.lit(0))


def handed_over(scored: DataFrame, good: float, part: float) -> DataFrame:
    """(h, taker, label, weight): about PSEUDO_ROWS rows of each class for each view, which the other view is sure of.

    scored holds (h, t, p, n) of all distinct unlabelled documents and how often each is there. Of each class a view hands
    over `part` of all documents, by the class's share, at most, its surest ones, as the histogram of its scores says. Of
    those, each group of the taker's scores gives an equal number, chosen by hash, and each stands for others of its group.
    """
    number = scored.agg(F.sum("n")).first()[0] or 0
    out = None
    for giver, taker, own, other in (("text", "page", "t", "p"), ("page", "text", "p", "t")):
        cells = scored.groupBy(_bin(F.col(own)).alias("bin"), _group(F.col(other)).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        table = np.array([tuple(r) for r in cells.collect()], dtype=np.int64).reshape(-1, 4)  # BINS * (len(SPREAD) + 1) at most
        for label, share in ((1, good), (0, 1 - good)):
            sure = int(np.ceil(np.log(SURE / (1 - SURE)) / WIDTH))
            side = table[table[:, 0] >= BINS // 2 + sure] if label else table[table[:, 0] < BINS // 2 - sure]
            surest = sorted(set(side[:, 0].tolist()), reverse=bool(label))
            taken, total = [], 0
            for b in surest:
                total += int(side[side[:, 0] == b, 2].sum())
                if taken and total > number * part * share:
                    break
                taken.append(b)
            side = side[np.isin(side[:, 0], taken)]
            groups = {int(g): int(side[side[:, 1] == g, 3].sum()) for g in set(side[:, 1].tolist())}
            for group, rows in groups.items():
                fraction = min(1.0, PSEUDO_ROWS / len(groups) / rows)
                lot = F.pmod(F.xxhash64("h", F.lit(f"{taker}{label}")), F.lit(1 << 30)) < int(fraction * (1 << 30))
                some = scored.where(_bin(F.col(own)).between(min(taken), max(taken)) & (_group(F.col(other)) == group) & lot)
                some = some.select("h", F.lit(taker).alias("taker"), F.lit(label).alias("label"), F.sqrt(F.col("n") / fraction).alias("weight"))
                out = some if out is None else out.unionByName(some)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> Views:
    """Views fitted on at most LABELLED_ROWS labelled documents, and in ROUNDS rounds on what the views hand each other of
    all unlabelled ones.

    Labels that are null count as none, repeated labels of a document as their majority, ties as good; labels of no document
    play no part. Of rows that share a labelled id one is read; unlabelled rows that are alike are one row that weighs as many.
    Without labels of both classes everything is kept.
    """
    rows = _inputs(docs, text)
    votes = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    votes = votes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    picked = rows.select("doc_id").distinct().join(votes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    picked = written(picked.select("doc_id", F.lit("").alias("taker"), "label", F.lit(1.0).alias("weight")), "quality-labelled")
    known = written(_examples_of(rows, picked, "doc_id"), "quality-labelled")
    shares = known.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if shares[1] != 0 or shares[2] != 1:
        return _keep_all()
    views = _fit_in_a_task(known)
    unlabelled = None
    for number in range(1, ROUNDS + 1):
        scores = _scored(rows, views.text, views.page).join(votes.select("doc_id"), "doc_id", "left_anti")
        # Rows that are alike have the same scores.
        unlabelled = written(scores.groupBy("h").agg(F.max("t").alias("t"), F.max("p").alias("p"), F.count("*").alias("n")), "quality-scores")
        chosen = handed_over(unlabelled, float(shares[0]), number * HANDED_OVER / 1000)
        if chosen is None:
            break
        hashed = rows.withColumn("h", F.xxhash64("text", "lang", "source", "n_chars"))
        given = written(_examples_of(hashed, written(chosen, "quality-chosen"), "h"), "quality-given")
        views = _fit_in_a_task(known.unionByName(given))
    return views


def score(docs: DataFrame, views: Views, text: str = "text") -> DataFrame:
    """doc_id with both views' and the joint probability of being good, and whether the document is kept.

    One row for each row, whatever its id; a null text counts as empty, null names and sizes as unknown; equal rows get equal
    scores; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, xt, xp in _steps(batches):
            logits = views.logits(views.text.logit(xt), views.page.logit(xp))
            odds = [pa.array(_sigmoid(z)) for z in logits]
            yield pa.record_batch([step["doc_id"], odds[1], odds[2], odds[0], pa.array(logits[0] >= views.keep_from)], names=["doc_id", "p_text", "p_page", "p_good", "kept"])

    return _inputs(docs, text).mapInArrow(run, "doc_id long, p_text double, p_page double, p_good double, kept boolean")


def apply(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns, whatever those are named; else as score()."""
    views = fit(docs, labels, text=text)
    own = ["lang", "source", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        for batch in batches:
            for part in by_bytes(batch):
                for i in range(0, part.num_rows, STEP_ROWS):
                    step = part.slice(i, STEP_ROWS)
                    xt = text_features([t or b"" for t in step[text].cast(pa.string()).cast(pa.binary()).to_pylist()])
                    columns = [step[c].to_pylist() if c in step.schema.names else [None] * step.num_rows for c in own]
                    names = [[None if v is None else str(v) for v in c] for c in columns[:2]]
                    sizes = [v if isinstance(v, int) else None for v in columns[2]]
                    logit = views.logits(views.text.logit(xt), views.page.logit(page_features(*names, sizes)))[0]
                    yield step.filter(pa.array(logit >= views.keep_from))

    return docs.mapInArrow(run, docs.schema)
