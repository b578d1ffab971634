"""Near duplicates of embeddings by counting collisions in many sorted one-dimensional projections.

The directions of the projections are all pairs of one random direction in each half of the rotated space, so many of
them cost few products. A vector is entered in the projections where it stands out, those of its largest values. In a
projection, sorted by value, it collides with what lies in a window around it: in its own strip of values or the next
one. Pairs that collide often enough are verified by their cosine. Entries, window and count are calibrated on simulated
pairs right at the wanted cosine, so that the wanted share of them passes; the number of projections grows with the
vectors, so that a list has about the same length at any size.

Equal vectors are one class. A class goes once to each cell that it has entries in, a cell being a direction of the first
half; a large cell is dealt by the directions of the second half, a projection with very many entries in blocks, and a pair
of blocks is one task. In a projection the cosines of all that collide are products of matrices, and only pairs that pass
are counted. A pair of vectors counts in the first projection that it collides in. A task yields numbers of links and the
links that connect its classes, not all pairs.

The tasks are done in passes, so many that what is shuffled in one of them stays in proportion to the vectors; its files go
when the pass has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import by_bytes, written
from matchlake.llm.graph import components
from matchlake.session import new_work_dir

SEED = 20240501
#: Entries of a projection on average, at most; simulated pairs; share of them that has to pass.
LIST_LENGTH = 1000
SIMULATED = 3000
RECALL = 0.995
#: Numbers of entries of a vector that are tried, until enough simulated pairs collide.
ENTRIES = (6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128)
#: Entries that a task of a cell holds at least and at most, and the number of tasks wanted between the two.
TASK_ENTRIES = (1 << 14, 1 << 19)
TASKS = 128
#: Entries from which a projection is dealt in blocks, and classes of a block on average.
BLOCK = 16384
#: Bytes that a pass shuffles: so many, or as a share of the bytes of all classes' vectors.
PASS_BYTES = 96 << 20
PASS_SHARE = 1.75
#: Bytes of classes that are dealt together, rows and columns of cosines that are made together.
DEAL_BYTES = 16 << 20
TILE = (512, 2048)
#: Strips of a projection have numbers from 1 to STRIPS - 2, so that a number's neighbours stay in its projection.
SHIFT = 4
STRIPS = 1 << SHIFT
MOST_DIRECTIONS = 11_585  # projections times strips are numbers of 32 bits
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Projections:
    """What is calibrated for vectors of one length."""

    size: int
    directions: int
    entries: int
    window: float
    collisions: int
    origin: float = 0.0

    def spaces(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng([SEED, self.size, self.directions])
        turn = np.linalg.qr(rng.normal(size=(self.size, self.size)))[0]
        cut = (self.size + 1) // 2
        halves = [rng.normal(size=(self.directions, n)) for n in (cut, self.size - cut)]
        return turn, [h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12) for h in halves]

    def entered(self, unit: np.ndarray, spaces) -> tuple[np.ndarray, np.ndarray]:
        """Projections of each unit vector's largest values, in ascending order, and those values."""
        step = max(1, (1 << 20) // self.directions)  # values of all directions are laid out for so many vectors
        parts = [self._entered(unit[i : i + step], spaces) for i in range(0, max(1, len(unit)), step)]
        return np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])

    def _entered(self, unit: np.ndarray, spaces) -> tuple[np.ndarray, np.ndarray]:
        turn, (first, second) = spaces
        turned = unit @ turn
        cut = first.shape[1]
        most = min(self.entries, self.directions)
        sides = []
        for values in (turned[:, :cut] @ first.T, turned[:, cut:] @ second.T):
            top = np.argpartition(values, -most, axis=1)[:, -most:]
            best = np.take_along_axis(values, top, 1)
            order = np.argsort(-best, axis=1)
            sides.append((np.take_along_axis(top, order, 1), np.take_along_axis(best, order, 1)))
        (i, a), (j, b) = sides
        # A sum among the largest has no more of them above it than pairs of a value and one of rank no worse.
        p, q = (x.ravel() for x in np.divmod(np.arange(most * most), most))
        some = (p + 1) * (q + 1) <= self.entries
        p, q = p[some], q[some]
        sums = a[:, p] + b[:, q]
        kept = min(self.entries, sums.shape[1])
        top = np.argpartition(sums, -kept, axis=1)[:, -kept:]
        keys = np.take_along_axis(i, p[top], 1) * self.directions + np.take_along_axis(j, q[top], 1)
        values = np.take_along_axis(sums, top, 1)
        order = np.argsort(keys, axis=1)
        return np.take_along_axis(keys, order, 1), np.take_along_axis(values, order, 1)

    def tokens(self, unit: np.ndarray, spaces) -> np.ndarray:
        """Each entry's projection and strip in one number, in ascending order."""
        keys, values = self.entered(unit, spaces)
        strips = np.floor((values - self.origin) / max(self.window, 1e-9))
        return (keys * STRIPS + np.clip(strips, 1, STRIPS - 2).astype(np.int64)).astype(np.int32)


def _shared(ka: np.ndarray, va: np.ndarray, kb: np.ndarray, vb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of pairs: which entries of a are b's too, and how far the values are apart there."""
    same = ka[:, :, None] == kb[:, None, :]
    return same, np.abs(va[:, :, None] - vb[:, None, :])


def calibrate(size: int, classes: int, cosine: float) -> Projections:
    """Projections for so many classes: the fewest entries and their window that bring enough pairs together, then the highest
    count that enough of them reach."""
    rng = np.random.default_rng([SEED, size])
    x = rng.normal(size=(SIMULATED, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + np.sqrt(1 - cosine * cosine) * z
    for entries in ENTRIES:
        directions = min(MOST_DIRECTIONS, max(4, int(np.ceil(np.sqrt(classes * entries / LIST_LENGTH)))))
        trial = Projections(size, directions, entries, 0.0, 1)
        spaces = trial.spaces()
        (ka, va), (kb, vb) = trial.entered(x, spaces), trial.entered(y, spaces)
        parts = [_shared(ka[i : i + 500], va[i : i + 500], kb[i : i + 500], vb[i : i + 500]) for i in range(0, SIMULATED, 500)]
        far = np.concatenate([d[same] for same, d in parts])
        window = float(np.quantile(far, RECALL)) if len(far) else 1.0
        hits = np.sort(np.concatenate([(same & (d <= window)).sum(axis=(1, 2)) for same, d in parts]))
        if (hits >= 1).mean() >= RECALL:
            break
    origin = float(np.quantile(va, 0.01)) - window
    return Projections(size, directions, entries, window, max(1, int(hits[int((1 - RECALL) * len(hits))])), origin)


def _binary(data: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """The bytes of each row, or of the rows up to each end."""
    data = np.ascontiguousarray(data)
    width = data.itemsize * int(np.prod(data.shape[1:]))
    ends = np.arange(1, len(data) + 1) if ends is None else ends
    offsets = np.concatenate([[0], ends * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.reshape(-1).view(np.uint8))])


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of binaries, and where each begins, the end of the last with them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return _bytes(column)[0].view(kind).reshape(-1, width)


def _classed(rows: DataFrame, kind: str, vectors: bool) -> DataFrame:
    """vec_id, id of the class of equal vectors (null if it links with nothing), length; or those that link with the bytes of
    the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in by_bytes(batch):
                ids, column = part["vec_id"], part["embedding"]
                offsets = column.offsets.to_numpy().astype(np.int64)
                # A null becomes NaN and so is not finite.
                flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
                lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
                live = np.zeros(len(ids), dtype=bool)
                for size in np.unique(lengths[lengths > 0]).tolist():
                    at = np.flatnonzero(lengths == size)
                    x = flat[(offsets[at] - offsets[0])[:, None] + np.arange(size)] + flat.dtype.type(0)  # no negative zero
                    with np.errstate(over="ignore", invalid="ignore"):
                        square = np.einsum("ij,ij->i", x, x, dtype=np.float64)
                    fine = np.isfinite(x).all(axis=1) & np.isfinite(square) & (square > 0)
                    at, x = at[fine], np.ascontiguousarray(x[fine])
                    live[at] = True
                    if len(at):
                        cids = pa.array([xxhash.xxh3_128_digest(v) for v in x], pa.binary())
                        out = [ids.take(pa.array(at)), cids, pa.array(np.full(len(at), size, np.int32))]
                        yield pa.record_batch([*out, _binary(x)], names=["vec_id", "cid", "size", "vector"]) if vectors else pa.record_batch(out, names=["vec_id", "cid", "size"])
                dead = np.flatnonzero(~live)
                if len(dead) and not vectors:
                    yield pa.record_batch([ids.take(pa.array(dead)), pa.nulls(len(dead), pa.binary()), pa.array(np.zeros(len(dead), np.int32))], names=["vec_id", "cid", "size"])

    return rows.mapInArrow(run, "vec_id long, cid binary, size int" + (", vector binary" if vectors else ""))


def _by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one length of vector, of about so many bytes together."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        whole = pa.Table.from_batches(held).combine_chunks()
        sizes = whole["size"].to_numpy()
        for size in np.unique(sizes).tolist():
            for part in (whole if (sizes == size).all() else whole.filter(pa.array(sizes == size)).combine_chunks()).to_batches():
                yield size, part

    held, n = [], 0
    for batch in batches:
        for part in by_bytes(batch, most):
            if part.num_rows:
                held.append(part)
                n += part.nbytes
            if n >= most:
                yield from cut(held)
                held, n = [], 0
    if held:
        yield from cut(held)


def _entries(classes: DataFrame, plans: dict[int, Projections], kind: str) -> DataFrame:
    """Each class with the tokens of its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = {}
        for batch in batches:
            for size, part in _by_size(iter([batch]), 4 << 20):
                plan = plans[size]
                if size not in spaces:
                    turn, halves = plan.spaces()
                    spaces[size] = turn.astype(np.float32), [h.astype(np.float32) for h in halves]
                unit, _ = _units(_matrix(part["vector"], kind, size))
                tokens = plan.tokens(unit, spaces[size])
                yield pa.record_batch([*(part[c] for c in ("cid", "least", "times", "size", "vector")), _binary(tokens)], names=["cid", "least", "times", "size", "vector", "tokens"])

    return classes.mapInArrow(run, "cid binary, least long, times long, size int, vector binary, tokens binary")


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, lengths in double precision."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    unit = np.empty(x.shape, np.float32)
    for i in range(0, len(x), 8192):
        unit[i : i + 8192] = x[i : i + 8192] / length[i : i + 8192, None]
    return unit, length


@dataclass(frozen=True)
class Layout:
    """The tasks for vectors of one length: parts of cells first, then pairs of blocks of each hot projection."""

    plan: Projections
    base: np.ndarray  # first task of each cell
    parts: np.ndarray  # tasks of each cell
    hot: np.ndarray  # projections in blocks, ascending
    blocks: np.ndarray  # blocks of each
    hot_base: np.ndarray  # first task of each
    passes: int

    def is_hot(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(keys.shape, dtype=bool), np.zeros(keys.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return self.hot[at] == keys, at

    def turn(self, tasks: np.ndarray) -> np.ndarray:
        """The pass of each task."""
        return ((tasks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.passes

    def tasks(self, tokens: np.ndarray, cids: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Task, row and side of what is to be done in a pass, by task."""
        keys = (tokens >> SHIFT).astype(np.int64)
        cell, other = np.divmod(keys, self.plan.directions)
        hot, at = self.is_hot(keys)
        task = self.base[cell] + other % self.parts[cell]
        row, col = np.nonzero(~hot & (self.turn(task) == now))
        codes = np.unique(task[row, col] * len(tokens) + row)
        out = [(codes // len(tokens), codes % len(tokens), np.zeros(len(codes), np.int8))]
        row, col = np.nonzero(hot)
        if len(row):
            h = at[row, col]
            of = self.blocks[h]
            own = (cids[row].astype(np.uint64) % of.astype(np.uint64)).astype(np.int64)
            row, h, own, n = (np.repeat(v, of) for v in (row, h, own, of))
            other = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of)
            x, y = np.minimum(own, other), np.maximum(own, other)
            task = self.hot_base[h] + x * n - x * (x - 1) // 2 + y - x  # pairs of blocks, row by row
            ok = self.turn(task) == now
            out.append((task[ok], row[ok], (own > other)[ok].astype(np.int8)))
        task, row, side = (np.concatenate(v) for v in zip(*out, strict=True))
        order = np.lexsort((side, task))
        return task[order], row[order], side[order]

    def work(self, task: int) -> tuple[int, int, int, bool]:
        """Cell and part of a task, or -1, the projection in blocks and whether it is one block with itself."""
        if len(self.hot) and task >= self.hot_base[0]:
            h = int(np.searchsorted(self.hot_base, task, "right")) - 1
            left, n, x = task - int(self.hot_base[h]), int(self.blocks[h]), 0
            while left >= n - x:
                left, x = left - (n - x), x + 1
            return -1, 0, int(self.hot[h]), left == 0
        cell = int(np.searchsorted(self.base, task, "right")) - 1
        return cell, task - int(self.base[cell]), -1, True


def _counts(rows: DataFrame, plans: dict[int, Projections], classes: dict[int, int]) -> DataFrame:
    """size, kind, id, n: entries (0) and classes (1) of each cell, entries of a projection (2) where there are many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part in _by_size(batches, DEAL_BYTES):
            plan = plans[size]
            keys = (_matrix(part["tokens"], "<i4", _width(plan)) >> SHIFT).astype(np.int64)
            cells = keys // plan.directions
            new = np.ones(cells.shape, dtype=bool)
            new[:, 1:] = cells[:, 1:] != cells[:, :-1]
            lists, n = np.unique(keys, return_counts=True)
            # What is left out of all slices together is a quarter of a block at most.
            many = n >= part.num_rows * BLOCK / (4 * classes[size])
            for kind, (ids, n) in enumerate((np.unique(cells, return_counts=True), np.unique(cells[new], return_counts=True), (lists[many], n[many]))):
                yield pa.record_batch([pa.array(np.full(len(ids), size, np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(n.astype(np.int64))], names=["size", "kind", "id", "n"])

    found = rows.select("size", "tokens").mapInArrow(run, "size int, kind int, id long, n long")
    return found.groupBy("size", "kind", "id").agg(F.sum("n").alias("n")).where(f"kind < 2 OR n > {BLOCK * 3 // 4}")


def _width(plan: Projections) -> int:
    """Entries that a vector really has."""
    most = min(plan.entries, plan.directions)
    return min(plan.entries, sum(min(most, plan.entries // (p + 1)) for p in range(most)))


def _layouts(rows: DataFrame, plans: dict[int, Projections], classes: dict[int, int], width: int) -> dict[int, Layout]:
    """Tasks and passes from the numbers of entries; what comes to the driver are cells and hot projections."""
    counts: dict[int, list] = {size: [[], [], []] for size in plans}
    for r in _counts(rows, plans, classes).collect():
        counts[r["size"]][r["kind"]].append((r["id"], r["n"]))
    bytes_, out = 0, {}
    for size, plan in plans.items():
        entries, copies = np.zeros(plan.directions, np.int64), np.zeros(plan.directions, np.int64)
        for into, found in ((entries, counts[size][0]), (copies, counts[size][1])):
            for i, n in found:
                into[i] = n
        hot = np.array(sorted(counts[size][2]), dtype=np.int64).reshape(-1, 2)
        np.subtract.at(entries, hot[:, 0] // plan.directions, hot[:, 1])
        entries = np.maximum(entries, 0)
        each = min(max(int(entries.sum()) // TASKS, TASK_ENTRIES[0]), TASK_ENTRIES[1])
        parts = np.minimum(np.maximum(1, -(-entries // each)), plan.directions)
        blocks = np.maximum(1, -(-hot[:, 1] // BLOCK))
        pairs = blocks * (blocks + 1) // 2
        base = np.cumsum(parts) - parts
        out[size] = (plan, base, parts, hot[:, 0].copy(), blocks, int(parts.sum()) + np.cumsum(pairs) - pairs)
        # A class with k entries in a cell goes to so many of its parts, were they dealt at random.
        k = entries / np.maximum(copies, 1)
        moved = int((copies * parts * (1 - (1 - 1 / parts) ** k)).sum()) + int((hot[:, 1] * blocks).sum())
        bytes_ += moved * (size * width + 4 * _width(plan) + 24)
    least = sum(n * (size * width + 24) for size, n in classes.items())
    passes = max(1, -(-bytes_ // max(PASS_BYTES, int(PASS_SHARE * least))))
    return {size: Layout(*x, passes) for size, x in out.items()}


def _dealt(rows: DataFrame, layouts: dict[int, Layout], now: int) -> DataFrame:
    """The classes of each task of a pass, in rows of many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part in _by_size(batches, DEAL_BYTES):
            layout = layouts[size]
            cids, vectors = _matrix(part["cid"], "V16", 1)[:, 0], _bytes(part["vector"])[0].reshape(part.num_rows, -1)
            tokens, times = _matrix(part["tokens"], "<i4", _width(layout.plan)), part["times"].to_numpy()
            # Blocks are told by the second half of the id.
            task, row, side = layout.tasks(tokens, cids.view("<u8").reshape(-1, 2)[:, 1], now)
            start, most = 0, max(1, 2 * DEAL_BYTES // (vectors.shape[1] + 4 * tokens.shape[1] + 24))
            cuts = np.flatnonzero(np.diff(task * 2 + side, prepend=-1))
            while start < len(task):  # whole groups, as many as fit
                stop = int(cuts[np.searchsorted(cuts, start + most, "right") - 1]) if start + most < len(task) else len(task)
                stop = stop if stop > start else int(np.append(cuts, len(task))[np.searchsorted(cuts, start, "right")])
                r, heads = row[start:stop], cuts[(cuts >= start) & (cuts < stop)]
                ends = np.append(heads[1:], stop) - start
                yield pa.record_batch(
                    [pa.array(np.full(len(heads), size, np.int32)), pa.array(task[heads]), pa.array(side[heads].astype(np.int32)), *(_binary(v[r], ends) for v in (cids, times, vectors, tokens))],
                    names=["size", "task", "side", "cids", "times", "vectors", "tokens"],
                )
                start = stop

    return rows.select("cid", "times", "size", "vector", "tokens").mapInArrow(run, "size int, task long, side int, cids binary, times binary, vectors binary, tokens binary")


#: Pairs of a row with itself or one before it.
_BELOW = np.tri(TILE[0], dtype=bool)


class _Task:
    """The classes of a task, and what of them is linked."""

    def __init__(self, table: pa.Table, plan: Projections, kind: str, cosine: float):
        self.cids = _matrix(table["cids"], "V16", 1)[:, 0]
        self.times = _matrix(table["times"], "<i8", 1)[:, 0].astype(np.float64)
        self.x, self.tokens = _matrix(table["vectors"], kind, plan.size), _matrix(table["tokens"], "<i4", _width(plan))
        rows = np.diff(_bytes(table["cids"])[1]) // 16
        self.side = np.repeat(table["side"].to_numpy(), rows)
        self.unit, self.length = _units(self.x)
        self.plan, self.cosine = plan, cosine
        #: How far a cosine in single precision may be off.
        self.off = 1e-5 + 1.2e-7 * plan.size
        self.n = np.zeros(len(self.cids))
        self.top = list(range(len(self.cids)))

    def find(self, u: int) -> int:
        top = self.top
        while top[u] != u:
            top[u] = top[top[u]]
            u = top[u]
        return u

    def projection(self, key: int, a: np.ndarray, b: np.ndarray | None) -> None:
        """Counts the links of a projection's tokens: rows of a with each other, or with those of b; both by token."""
        own, (rows, columns) = b is None, TILE
        strips = [None if r is None else self._strips(r, key) for r in (a, b)]
        for i in range(0, len(a), rows):
            p, sp = a[i : i + rows], strips[0][i : i + rows]
            to, sto = (a, strips[0]) if own else (b, strips[1])
            low = i if own else int(np.searchsorted(sto, sp[0] - 1, "left"))
            high = int(np.searchsorted(sto, sp[-1] + 1, "right"))
            for j in range(low, high, columns):
                q, sq = to[j : min(j + columns, high)], sto[j : min(j + columns, high)]
                near = self.unit[p] @ self.unit[q].T
                if own and j == i:  # each pair once
                    np.copyto(near[:, : len(p)], -2, where=_BELOW[: len(p), : len(p)])
                if near.max() >= self.cosine - self.off:
                    self._judge(key, p, q, sp, sq, near)

    def _strips(self, rows: np.ndarray, key: int) -> np.ndarray:
        at = (self.tokens[rows] >> SHIFT) == key
        return self.tokens[rows][at] & (STRIPS - 1)

    def _judge(self, key: int, p: np.ndarray, q: np.ndarray, sp: np.ndarray, sq: np.ndarray, near: np.ndarray) -> None:
        i = np.flatnonzero(near.max(axis=1) >= self.cosine - self.off)
        near = near[i]
        j = np.flatnonzero(near.max(axis=0) >= self.cosine - self.off)
        p, q, near = p[i], q[j], near[:, j]
        ok = (near >= self.cosine - self.off) & (np.abs(sp[i][:, None] - sq[j][None, :]) <= 1)
        r, c = np.nonzero(ok & (near < self.cosine + self.off))
        for at in range(0, len(r), 20_000):
            u, v = r[at : at + 20_000], c[at : at + 20_000]
            exact = (self.x[p[u]].astype(np.float64) * self.x[q[v]]).sum(axis=1) / (self.length[p[u]] * self.length[q[v]])
            ok[u, v] = exact >= self.cosine
        if ok.any():
            ok &= self._collisions(p, q, key) == 0  # else it counts there
        if self.plan.collisions > 1 and ok.any():
            ok &= self._collisions(p, q, None) >= self.plan.collisions
        if ok.any():
            self.n[p] += ok @ self.times[q]
            self.n[q] += self.times[p] @ ok
            self._connect(p, q, ok)

    def _collisions(self, p: np.ndarray, q: np.ndarray, before: int | None) -> np.ndarray:
        """Collisions of each row of p with each of q in all projections, or in those before one."""
        tp, tq = self.tokens[p], self.tokens[q]
        rp, cp = np.nonzero(tp < before * STRIPS if before is not None else np.ones(tp.shape, dtype=bool))
        rq, cq = np.nonzero(tq < before * STRIPS if before is not None else np.ones(tq.shape, dtype=bool))
        all_, place = np.unique(tp[rp, cp], return_inverse=True)
        if not len(all_) or not len(rq):
            return np.zeros((len(p), len(q)), np.float32)
        own = tq[rq, cq]
        found = []
        for d in (-1, 0, 1):  # the strip itself and its neighbours
            at = np.minimum(np.searchsorted(all_, own + d), len(all_) - 1)
            hit = all_[at] == own + d
            found.append((rq[hit], at[hit]))
        rq, at = (np.concatenate(v) for v in zip(*found, strict=True))
        both, at = np.unique(at, return_inverse=True)
        new = np.full(len(all_), -1)
        new[both] = np.arange(len(both))
        place = new[place]
        left, right = np.zeros((len(p), len(both)), np.float32), np.zeros((len(q), len(both)), np.float32)
        left[rp[place >= 0], place[place >= 0]] = 1
        right[rq, at] = 1
        return left @ right.T

    def _connect(self, p: np.ndarray, q: np.ndarray, ok: np.ndarray) -> None:
        p_, q_ = p.tolist(), q.tolist()
        while True:
            lp, lq = np.array([self.find(u) for u in p_]), np.array([self.find(v) for v in q_])
            apart = ok & (lp[:, None] != lq[None, :])
            rows, cols = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(rows):
                return
            # One such link of each row and column: what they leave apart is half of it at most.
            some = [*zip(rows.tolist(), apart[rows].argmax(axis=1).tolist(), strict=True), *zip(apart[:, cols].argmax(axis=0).tolist(), cols.tolist(), strict=True)]
            for r, c in some:
                u, v = self.find(p_[r]), self.find(q_[c])
                self.top[max(u, v)] = min(u, v)

    def links(self) -> pa.Table:
        rows = np.flatnonzero(self.n)
        tops = np.array([self.find(r) for r in rows.tolist()], dtype=np.int64)
        return pa.table({"cid": _binary(self.cids[rows]), "n": pa.array(np.rint(self.n[rows]).astype(np.int64)), "other": _binary(self.cids[tops])})


def _linked(dealt: DataFrame, layouts: dict[int, Layout], kind: str, cosine: float) -> DataFrame:
    """cid, n links to rows of other classes, and other: a class it is linked to, or itself."""

    def run(table: pa.Table) -> pa.Table:
        layout = layouts[table["size"][0].as_py()]
        cell, part, key, same = layout.work(table["task"][0].as_py())
        task = _Task(table, layout.plan, kind, cosine)
        if key >= 0:
            row, col = np.nonzero((task.tokens >> SHIFT) == key)
            row = row[np.argsort(task.tokens[row, col], kind="stable")]
            sides = [row[task.side[row] == s] for s in (0, 1)]
            task.projection(key, sides[0], None if same else sides[1])
            return task.links()
        keys = task.tokens >> SHIFT
        in_cell, other = np.divmod(keys, layout.plan.directions)
        row, col = np.nonzero((in_cell == cell) & (other % layout.parts[cell] == part) & ~layout.is_hot(keys)[0])
        order = np.argsort(task.tokens[row, col], kind="stable")
        row, key = row[order], keys[row, col][order]
        for rows in np.split(np.arange(len(row)), np.flatnonzero(np.diff(key)) + 1):
            if len(rows) > 1:
                task.projection(int(key[rows[0]]), row[rows], None)
        return task.links()

    return dealt.groupBy("size", "task").applyInArrow(run, "cid binary, n long, other binary")


def _compare(rows: DataFrame, layouts: dict[int, Layout], kind: str, cosine: float) -> DataFrame:
    """The links of all passes."""
    spark = rows.sparkSession
    top, paths = new_work_dir(spark, "embedding-links"), []
    for now in range(next(iter(layouts.values())).passes if layouts else 1):
        found = _linked(_dealt(rows, layouts, now), layouts, kind, cosine)
        paths.append(f"{top}/pass-{now}")
        found.write.parquet(paths[-1])
    return spark.read.schema(found.schema).parquet(*paths)


@contextmanager
def _shuffles_go(spark: SparkSession):
    """What a written step has shuffled goes when the step has ended, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def near_duplicates(rows: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Rows are linked if their cosine in double precision is at least the given one and the projections bring them
    together. Vectors that are null, empty, zero or hold a null or a component that is not finite are linked with
    nothing, vectors of different lengths not with each other. Rows that repeat link with each other. A component's id
    is the smallest vec_id in it.
    """
    single = isinstance(rows.schema[vector].dataType, T.ArrayType) and isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    given = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("embedding"))
    with _shuffles_go(rows.sparkSession):
        all_ = written(_classed(given, kind, False), "embedding-rows")
        classes = {r["size"]: r["n"] for r in all_.where("cid IS NOT NULL").groupBy("size").agg(F.countDistinct("cid").alias("n")).collect()}  # one row for each length
        plans = {size: calibrate(size, n, cosine) for size, n in classes.items()}
        vectors = _classed(given, kind, True).groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("size").alias("size"), F.first("vector").alias("vector"))
        entered = written(_entries(vectors, plans, kind), "embedding-entries")
        found = _compare(entered, _layouts(entered, plans, classes, width), kind, cosine)
        links = found.groupBy("cid").agg(F.sum("n").alias("n"))
        groups = components(found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
        named = entered.select("cid", "least", "times").join(links, "cid", "left").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        named = written(named, "embedding-named")
        ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(ids, "component").select(F.col("cid").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = all_.select("vec_id", "cid").join(named, F.col("cid") == F.col("of"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
