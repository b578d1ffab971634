"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct word shingles; its sketch keeps the k smallest hashes. Equal sets are one class. The
inverted lists of retained values bring classes together: two sets that are alike enough share so many retained values
that they meet in a list of one of their rarer ones (a prefix of the sketch, rarest first), so only those lists are
built. Classes that meet, directly or over others, form a group. Inside a group one class is compared with all others
first; those linked to it are of one component and never compared with each other. All other pairs are compared in
blocks: overlaps of the sketches estimate the likeness in the sketch of the union, and pairs near or above the
threshold are confirmed on their whole sets. A block yields the links that connect its classes, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_bytes, fresh_name, utf8, worker_table, written
from matchlake.llm.graph import components

#: ASCII capitals to small letters, words of a shingle.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = 5
#: Retained values of a sketch.
K = 64
#: Standard deviations that an overlap may fall short of its mean: a chance of about one in a million for a pair right at the threshold.
SIGMAS = 5.0
#: Classes and set values that a block holds on average.
BLOCK_CLASSES, BLOCK_VALUES = 256, 400_000
#: Hashes of words that a worker keeps.
KEPT_WORDS = 200_000
#: Class ids that are broadcast at most, to fetch the texts of candidates; more are joined.
BROADCAST_ROWS = 1_000_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def _words() -> _Words:
    return worker_table("words", _Words)


#: Odd multipliers, one for each word of a shingle.
_STEPS = np.array([0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & (2**64 - 1) for i in range(WORDS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words, one of the whole sequence; of none, nothing."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    if len(hashes) < WORDS:
        return _mixed(np.array([int((hashes * _STEPS[: len(hashes)]).sum()) + len(hashes) & (2**64 - 1)], dtype=np.uint64))
    total = hashes[: len(hashes) - WORDS + 1] * _STEPS[0]
    for i in range(1, WORDS):
        total = total + hashes[i : len(hashes) - WORDS + 1 + i] * _STEPS[i]
    return np.unique(_mixed(total))


def least_overlap(n: int, share: float, k: int = K) -> int:
    """Retained values that the sketch of a set of n has in common with that of any set alike by the share or more."""
    if n <= k:
        # The other set may be larger than a sketch, and its sketch then lacks what is beyond the k smallest.
        return max(1, math.ceil(share * n - 1e-9) - max(0, math.floor(n / share + 1e-9) - k))
    return max(1, math.floor(share * k - SIGMAS * math.sqrt(share * (1 - share) * k)))


def sketched(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """doc_id, hash of the text, n shingles, id of the set (null if empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in by_bytes(batch):
                sizes, ids, kept = [], [], []
                for t in part["text"].to_pylist():
                    values = shingles(t)
                    sizes.append(len(values))
                    ids.append(xxhash.xxh3_128_digest(values) if len(values) else None)
                    kept.append(values[:k].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept)))
                yield pa.record_batch([part["doc_id"], part["h"], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), lists], names=["doc_id", "h", "n", "sid", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, h long, n long, sid binary, sketch array<long>")


def meetings(classes: DataFrame, share: float, k: int = K) -> DataFrame:
    """sid, value: the lists that each class is in. A value of one class only makes no list, but takes its place as the rarest."""
    values = classes.select("sid", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    shared = values.join(often, "value").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("shared"))  # at most k of a class
    short = F.create_map(*[F.lit(x) for n in range(k + 1) for x in (n, least_overlap(n, share, k))])
    least = F.coalesce(F.try_element_at(short, F.least(F.col("n"), F.lit(k + 1)).cast("int")), F.lit(least_overlap(k + 1, share, k)))
    retained = F.least(F.col("n"), F.lit(k))
    prefix = (retained - least + 1) - (retained - F.size("shared"))  # the rest of the prefix are values of this class alone
    return shared.where(prefix > 0).select("sid", F.explode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("s")).select("sid", "s.value")


def _fetch(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """sid, group, n, values: the whole sets of the wanted classes (sid, doc_id, group) from one document of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    chosen = wanted.select(F.col("doc_id").alias("of"), F.col("sid").alias("want"), "group")
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = rows.join(F.broadcast(chosen) if few else chosen, F.col("doc_id").eqNullSafe(F.col("of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in by_bytes(batch):
                out = []
                for t, sid, group in zip(part["text"].to_pylist(), part["want"].to_pylist(), part["group"].to_pylist()):
                    values = shingles(t)
                    if xxhash.xxh3_128_digest(values) == sid:  # other rows may have the same doc_id
                        out.append((sid, group, len(values), values.view(np.int64)))
                yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], names=["sid", "group", "n", "values"])

    sets = hit.select("text", "want", "group").mapInArrow(run, "sid binary, `group` binary, n long, `values` array<long>")
    return sets.dropDuplicates(["sid"])


class _Block:
    """Sets and sketches of some classes, ready to be compared with one class at a time."""

    def __init__(self, sets: list[np.ndarray], k: int):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.kept = np.minimum(self.sizes, k)
        self.sketch = np.full((len(sets), k), 2**64 - 1, dtype=np.uint64)
        for row, s in zip(self.sketch, sets):
            row[: min(k, len(s))] = s[:k]
        # The largest retained value bounds what the sketch knows; a sketch that is the whole set knows all.
        self.knows = np.where(self.sizes > k, self.sketch[:, -1], np.uint64(2**64 - 1))
        self.universe, places = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.places = places

    def overlaps(self, values: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Values in common with each of the columns' whole sets."""
        mark = np.zeros(len(self.universe) + 1, dtype=np.int64)
        found = np.searchsorted(self.universe, values)
        found = found[(found < len(self.universe)) & (self.universe[np.minimum(found, len(self.universe) - 1)] == values)]
        mark[found] = 1
        sizes = self.sizes[columns]
        ends = np.cumsum(sizes)
        inside = mark[self.places[np.repeat(self.at[columns] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]]
        return np.add.reduceat(inside, ends - sizes)

    def estimates(self, sketch: np.ndarray, knows: np.uint64, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likeness in the sketch of the union with each of the columns, and the values of that sketch."""
        limit = np.minimum(self.knows[columns], knows)[:, None]
        rows = self.sketch[columns]
        real = np.arange(rows.shape[1]) < self.kept[columns][:, None]
        known = real & (rows <= limit)
        place = np.minimum(np.searchsorted(sketch, rows), len(sketch) - 1)
        both = ((sketch[place] == rows) & known).sum(axis=1)
        union = known.sum(axis=1) + np.searchsorted(sketch, limit[:, 0], side="right") - both
        return both / np.maximum(union, 1), union


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, k: int) -> list[tuple[int, int]]:
    """Pairs (place in left, place in right, or both in left) that connect all classes linked in the block."""
    sets = left if right is None else [*left, *right]
    block = _Block(sets if right is None else right, k)
    top = list(range(len(sets)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    shift, share, out = (0 if right is None else len(left)), percent / 100, []
    for i, values in enumerate(left):
        columns = np.arange(i + 1, len(sets)) if right is None else np.arange(len(right))
        sizes = block.sizes[columns]
        columns = columns[(100 * np.minimum(sizes, len(values)) >= percent * np.maximum(sizes, len(values)))]
        columns = columns[[find(int(c) + shift) != find(i) for c in columns]] if len(columns) else columns
        if not len(columns):
            continue
        sketch = values[:k]
        guess, union = block.estimates(sketch, sketch[-1] if len(values) > k else np.uint64(2**64 - 1), columns)
        columns = columns[guess >= share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(union, 1))]
        if not len(columns):
            continue
        common = block.overlaps(values, columns)
        linked = columns[100 * common >= percent * (block.sizes[columns] + len(values) - common)]
        for c in linked.tolist():
            a, b = find(i), find(c + shift)
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((i, c))
    return out


def _values(column: pa.Array) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _star(sets: DataFrame, percent: int, k: int) -> DataFrame:
    """a, b, linked: each class of a group against the group's first."""
    heads = sets.groupBy("group").agg(F.min("sid").alias("sid")).join(sets, ["group", "sid"]).select("group", F.col("sid").alias("head"), F.col("values").alias("head_values"))
    pairs = sets.join(heads, "group").where("sid <> head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                linked = [bool(_links([x], [y], percent, k)) for x, y in zip(_values(part["values"]), _values(part["head_values"]))]
                yield pa.record_batch([part["sid"], part["head"], pa.array(linked)], names=["a", "b", "linked"])

    return pairs.select("sid", "head", "values", "head_values").mapInArrow(run, "a binary, b binary, linked boolean")


def _blocks(sets: DataFrame, star: DataFrame, percent: int, k: int) -> DataFrame:
    """a, b: links that connect what is linked in each group, but for pairs of classes both linked to its first."""
    # The first of a group is in no pair of the star; it is on the side of those linked to it.
    rows = sets.join(star.select(F.col("a").alias("sid"), "linked"), "sid", "left").withColumn("side", F.coalesce("linked", F.lit(True)).cast("int"))
    counts = rows.groupBy("group", "side").agg(F.count("*").alias("classes"), F.sum("n").alias("total"))
    counts = counts.withColumn("of", F.ceil(F.greatest(F.col("classes") / BLOCK_CLASSES, F.col("total") / BLOCK_VALUES)).cast("int"))
    rows = rows.join(counts.select("group", "side", "of"), ["group", "side"]).withColumn("block", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("of")).cast("int"))
    rows = written(rows.select("group", "side", "block", "sid", "values"), "near-blocks")
    each = counts.select("group", "side", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("block"))
    one = each.select("group", F.struct("side", "block").alias("x"))
    # Pairs of blocks, not of classes; two of the linked side need no comparison.
    two = one.join(one.select("group", F.col("x").alias("y")), "group").where("x <= y AND NOT (x.side = 1 AND y.side = 1)")
    two = two.withColumn("task", F.xxhash64("group", "x", "y"))
    both = two.select("task", "group", F.col("x.side").alias("side"), F.col("x.block").alias("block"), F.lit(0).alias("role")).unionByName(
        two.where("x <> y").select("task", "group", F.col("y.side").alias("side"), F.col("y.block").alias("block"), F.lit(1).alias("role"))
    )
    dealt = rows.join(both, ["group", "side", "block"]).select("task", "role", "sid", "values")

    def run(task: pa.Table) -> pa.Table:
        roles = task["role"].to_numpy()
        sids = task["sid"].to_pylist()
        values = _values(task["values"].combine_chunks())
        sides = [[i for i in np.flatnonzero(roles == r).tolist()] for r in (0, 1)]
        sides = [sorted(s, key=lambda i: sids[i]) for s in sides]
        left = [values[i] for i in sides[0]]
        if len(sides[1]):
            found = [(sides[0][a], sides[1][b]) for a, b in _links(left, [values[i] for i in sides[1]], percent, k)] if left else []
        else:
            found = [(sides[0][a], sides[0][b]) for a, b in _links(left, None, percent, k)]
        return pa.table({"a": pa.array([sids[a] for a, _ in found], pa.binary()), "b": pa.array([sids[b] for _, b in found], pa.binary())})

    return dealt.groupBy("task").applyInArrow(run, "a binary, b binary")


def classes_of(docs: DataFrame, percent: int, text: str = "text", k: int = K) -> tuple[DataFrame, DataFrame]:
    """doc_id, h, n, sid of each row, and sid, component of the classes that are linked to others."""
    share = percent / 100
    rows = written(sketched(docs, text, k), "near-sketches")
    classes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    met = written(meetings(classes, share, k), "near-lists")
    # Lists by their smallest class: edges from each class to it.
    hubs = met.groupBy("value").agg(F.min("sid").alias("hub"), F.count("*").alias("times")).where("times > 1")
    together = met.join(hubs, "value").select(F.col("sid").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    groups = components(together).select(F.col("node").alias("sid"), F.col("component").alias("group"))
    names = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(names.join(groups, "sid"), "near-wanted")
    sets = written(_fetch(docs, wanted, text), "near-sets")
    star = written(_star(sets, percent, k), "near-star")
    links = star.where("linked").select("a", "b").unionByName(_blocks(sets, star, percent, k))
    linked = components(links).select(F.col("node").alias("sid"), "component")
    return rows.select("doc_id", "h", "n", "sid"), linked


def decided(docs: DataFrame, percent: int, text: str = "text", k: int = K) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, and chosen: whether the row's class stands for its component.

    That is the class of the smallest doc_id, of several the one of the smallest id of its set. Rows without words stand
    for themselves.
    """
    rows, linked = classes_of(docs, percent, text, k)
    linked = written(linked, "near-components")
    tops = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least")).join(linked, "sid", "left")
    tops = written(tops.select("sid", "least", F.coalesce("component", "sid").alias("component")), "near-classes")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sid")).alias("first")
    named = tops.join(tops.groupBy("component").agg(first), "component")
    named = named.select(F.col("sid").alias("of"), F.col("first.least").alias("component_id"), (F.col("sid") == F.col("first.sid")).alias("chosen"))
    out = rows.join(named, rows["sid"] == named["of"], "left")
    component: Column = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    chosen = F.col("sid").isNull() | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), chosen.alias("chosen"))


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Two documents are linked if 100 * shingles in common >= percent * shingles of both together. A component's id is the
    smallest doc_id in it. Rows without words, null texts among them, are linked with nothing: their component is their
    own doc_id. Rows that repeat have the same result; a null doc_id comes last, and names a component of null ids only.
    """
    out = decided(docs, percent, text, k).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def apply(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """One row of each component, with its own columns; rows without words stay. Texts are not shuffled for it: what goes
    is few rows' keys, broadcast behind a check of their number and joined beyond it."""
    rows = written(decided(docs, percent, text).withColumn("some", F.col("n_shingles") > 0), "near-decided")
    out = rows.where("NOT chosen").select("doc_id", "h").distinct()
    again = rows.where("chosen AND some").groupBy("doc_id", "h").agg(F.count("*").alias("times")).where("times > 1").select("doc_id", "h")
    of, key, hashed = (fresh_name(docs, n) for n in ("near_of", "near_key", "near_hash"))
    left = docs.withColumn(of, F.xxhash64(utf8(text)))

    def meets(keys: DataFrame, how: str) -> DataFrame:
        keys = written(keys.select(F.col("doc_id").alias(key), F.col("h").alias(hashed)), "near-keys")
        few = keys.count() <= BROADCAST_ROWS
        return left.join(F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(of) == F.col(hashed)), how)

    once = meets(out.unionByName(again), "left_anti")
    repeated = meets(again, "left_semi").dropDuplicates(["doc_id", of])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
