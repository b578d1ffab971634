"""Secrets in whole texts: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns' findings always stand. The network reads each candidate, a run of characters that keys are made of, with
the text around it, and adds those that it takes for secrets. It is trained on labelled findings: what the patterns
find is a secret, unless it is digits only; other candidates, and candidates with one of the patterns' marks broken,
are not; made-up keys of other kinds in the places of found ones are. Its scores are calibrated on held-out documents,
and the threshold is the highest that still finds the wanted share of held-out secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_bytes, no_table, utf8, written

#: The base patterns in the order they are listed, with the part whose length counts and its least length.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Where an assignment can begin: texts without one of these need no search.
_KEYS = re.compile(r"(?ai:passw|secret|token|api_?key)")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: What the network looks at: runs of key characters of this length and more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
METHOD = "cnn"
#: Characters of a candidate and on each side of it that the network reads; a longer run is a candidate at each STRIDE characters.
WITHIN, AROUND = 40, 20
WIDTH = WITHIN + 2 * AROUND
STRIDE = WITHIN // 2
#: Shape of the network: size of a character's vector, width and number of the filters.
VECTOR, SPAN, FILTERS = 8, 5, 24
#: Bound of the labelled sample: so many texts with findings and so many others.
SAMPLE_DOCS = 1500
#: Share of held-out secrets that has to be found.
RECALL = 0.99


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the patterns' findings, by start, then as the kinds are listed."""
    out = []
    for order, (kind, pattern, part, least) in enumerate(BASE):
        if kind == "assign" and not _KEYS.search(text) or kind == "access" and "AKIA" not in text:
            continue
        found = _HEX.finditer(text) if kind == "hex" else pattern.finditer(text)  # maximal runs of 16 and more are the hex findings
        out += [(m.start(), order, m.end()) for m in found if m.end(part) - m.start(part) >= least]
    return [(start, end, BASE[order][0]) for start, order, end in sorted(out)]


def places(start: int, end: int) -> list[tuple[int, int]]:
    """The run itself, or the overlapping parts of WITHIN characters that a longer one is read in."""
    if end - start <= WITHIN:
        return [(start, end)]
    return [(a, a + WITHIN) for a in (*range(start, end - WITHIN, STRIDE), end - WITHIN)]


def candidates(text: str) -> list[tuple[int, int]]:
    return [p for m in CANDIDATE.finditer(text) for p in places(*m.span())]


def _shared(a: int, b: int, start: int, end: int) -> float:
    """Characters that both have in common, as a share of the shorter one."""
    return max(0, min(b, end) - max(a, start)) / max(1, min(b - a, end - start))


def window(text: str, start: int, end: int) -> str:
    """The candidate, of at most WITHIN characters, in its context at fixed places: what is before, the candidate, what is after."""
    before = text[max(0, start - AROUND) : start].rjust(AROUND, "\0")
    return before + text[start:end].ljust(WITHIN, "\0") + text[end : end + AROUND].ljust(AROUND, "\0")


def codes(windows: list[str]) -> np.ndarray:
    """Characters as numbers under 128; anything beyond ASCII is one of them."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), dtype="<u4").reshape(len(windows), WIDTH)
    return np.where(raw < 127, raw, 127).astype(np.int64)


@dataclass
class Network:
    """Vectors of characters, a convolution, the largest and the mean answer of each filter, one output."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def columns(self, x: np.ndarray) -> np.ndarray:
        e = self.vectors[x]  # rows, WIDTH, VECTOR
        return np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, SPAN * VECTOR)

    def forward(self, x: np.ndarray):
        cols = self.columns(x)
        answer = np.maximum(cols @ self.filters + self.bias, 0)
        best = answer.argmax(axis=1)
        inner = answer[:, AROUND : AROUND + WITHIN - SPAN + 1]
        hidden = np.concatenate((np.take_along_axis(answer, best[:, None, :], 1)[:, 0], inner.mean(axis=1), answer[:, : AROUND - SPAN + 1].max(axis=1), np.ones((len(x), 1), np.float32)), axis=1)
        return hidden @ self.out, hidden, cols, answer, best

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, rounds: int = 12, rate: float = 0.01) -> Network:
    """Adam on the log loss; the two classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (128, VECTOR)).astype(np.float32),
        rng.normal(0, (SPAN * VECTOR) ** -0.5, (SPAN * VECTOR, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 3 * FILTERS + 1).astype(np.float32),
    )
    parts = ["vectors", "filters", "bias", "out"]
    m, v, t = {k: 0.0 for k in parts}, {k: 0.0 for k in parts}, 0
    share = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(np.float32)
    near = AROUND - SPAN + 1
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            rows = order[i : i + 64]
            z, hidden, cols, answer, best = net.forward(x[rows])
            d = (share[rows] * (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)).astype(np.float32)
            dh = d[:, None] * net.out[None, :-1]
            da = np.zeros_like(answer)
            np.put_along_axis(da, best[:, None, :], dh[:, None, :FILTERS], 1)
            da[:, AROUND : AROUND + WITHIN - SPAN + 1] += (dh[:, None, FILTERS : 2 * FILTERS] / (WITHIN - SPAN + 1))
            left = answer[:, :near].argmax(axis=1)
            np.put_along_axis(da[:, :near], left[:, None, :], np.take_along_axis(da[:, :near], left[:, None, :], 1) + dh[:, None, 2 * FILTERS :], 1)
            da *= answer > 0
            dc = da @ net.filters.T
            grads = {"out": hidden.T @ d, "filters": np.tensordot(cols, da, ([0, 1], [0, 1])), "bias": da.sum(axis=(0, 1))}
            gv = np.zeros_like(net.vectors)
            places = np.lib.stride_tricks.sliding_window_view(x[rows], SPAN, axis=1)
            np.add.at(gv, places.ravel(), dc.reshape(-1, VECTOR))
            grads["vectors"] = gv
            t += 1
            for k in parts:
                g = grads[k] + 1e-4 * getattr(net, k)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


#: Letters that made-up keys are drawn from.
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef")
_NAMES = ("key", "auth", "bearer", "credential", "access_key", "client_secret", "private_key", "pwd")


def examples(texts: list[str], seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows, labels and the number of the text each comes from."""
    rng = np.random.default_rng(seed)
    out: list[tuple[str, int, int]] = []
    for n, text in enumerate(texts):
        base = [(a, b) for a, b, kind in base_spans(text) if kind != "hex" or not text[a:b].isdigit()]
        every = candidates(text)
        touched = [(a, b) for a, b in every if any(a < e and s < b for s, e in base)]
        strong = [(a, b) for a, b in touched if any(_shared(a, b, s, e) >= 0.5 for s, e in base)]
        for a, b in strong:
            out.append((window(text, a, b), 1, n))
            # A key of another kind, under another name, in the same place.
            letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
            made = "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(12, 49)))
            named = re.sub(r"(?ai:password|passwd|secret|token|api_?key)", _NAMES[rng.integers(len(_NAMES))], text[max(0, a - AROUND) : a])
            out += [(window(named + made + text[b : b + AROUND], *p), 1, n) for p in places(len(named), len(named) + len(made))]
            # Words and numbers in the same place are no keys.
            words = [m.group() for m, _ in zip(re.finditer(r"[A-Za-z]{3,}", text), range(200))] or ["text"]
            plain = "_".join(words[i] for i in rng.integers(len(words), size=4))[:40] if rng.random() < 0.5 else "".join("0123456789"[i] for i in rng.integers(10, size=16))
            out.append((window(text[max(0, a - AROUND) : a] + plain, min(a, AROUND), min(a, AROUND) + len(plain)), 0, n))
            # The key inside a long run: parts that hold it, or half of it, are secrets, parts without any of it are not.
            sides = ["/-_="[rng.integers(4)].join(words[i] for i in rng.integers(len(words), size=12)) for _ in range(2)]
            start, run = len(sides[0]) + 1, f"{sides[0]}/{made}/{sides[1]}"
            shares = [(p, _shared(*p, start, start + len(made))) for p in places(0, len(run))]
            out += [(window(run, *p), int(x > 0), n) for p, x in shares if x == 0 or x >= 0.5]
        found = set(touched)
        for a, b in every[:50]:
            if (a, b) not in found:
                out.append((window(text, a, b), 0, n))
        for m, _ in zip(re.finditer(r"\S{8,}", text), range(4)):
            if not any(m.start() < e and s < m.end() for s, e in base):
                out += [(window(text, *p), 0, n) for p in places(*m.span())]
    return [w for w, _, _ in out], np.array([y for _, y, _ in out]), np.array([n for _, _, n in out])


def fitted(windows: list[str], y: np.ndarray, of: np.ndarray) -> Network | None:
    """The network with calibration and threshold, or none if the sample holds no secret or nothing else.

    of numbers the text of each window; each fourth text is held out.
    """
    if not len(y) or y.min() == y.max():
        return None
    x, held = codes(windows), of % 4 == 3
    if y[held].sum() < 5 or y[~held].sum() < 5 or (1 - y[~held]).sum() < 5:
        held = np.zeros(len(y), dtype=bool)
    net = train(x[~held], y[~held].astype(np.float32))
    check = held if held.any() else np.ones(len(y), dtype=bool)
    z = np.concatenate([net.forward(x[check][i : i + 512])[0] for i in range(0, int(check.sum()), 512)]).astype(float)
    # Two numbers make the held-out log odds those of the labels.
    a, b, want = 1.0, 0.0, y[check]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a - 0.05 * (((p - want) * z).mean() + 1e-3 * (a - 1)), b - 0.05 * (p - want).mean()
    net.slope, net.shift = float(max(a, 1e-3)), float(b)
    p = np.sort(net.probability(x[check])[want == 1])
    net.threshold = float(min(p[int((1 - RECALL) * len(p))], 0.9))
    return net


def _examples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no_table()
    for batch in batches:
        for part in by_bytes(batch):
            out = []
            for h, t in zip(part["h"].to_pylist(), part["t"].to_pylist()):
                windows, y, _ = examples([t], h & 0x7FFFFFFF)
                out += [(h, w, int(v)) for w, v in zip(windows, y)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.string(), pa.int32()))], names=["h", "w", "y"])


def fit(docs: DataFrame, text: str = "text") -> Network | None:
    """The network from the findings of at most twice SAMPLE_DOCS texts: those of the smallest hashes among the texts
    that a pattern may match, and among the others. Their examples, not the texts, come to the driver."""
    rows = docs.select(utf8(text).alias("t")).withColumn("h", F.xxhash64("t"))
    keys = rows.select("h", F.col("t").rlike(r"(?i)(passw|secret|token|api_?key)|AKIA[A-Z0-9]{14}").alias("likely")).distinct()
    keys = written(keys, "secret-keys")
    picked = keys.where("likely").orderBy("h").limit(SAMPLE_DOCS).union(keys.where("NOT likely").orderBy("h").limit(SAMPLE_DOCS))
    # At most 3,000 numbers; texts that repeat count once.
    chosen = rows.join(F.broadcast(picked.select(F.col("h").alias("k"))), F.col("h") == F.col("k")).groupBy("h").agg(F.min("t").alias("t"))
    found = chosen.mapInArrow(_examples_of, "h long, w string, y int").toPandas().sort_values(["h", "y", "w"], kind="stable")
    return fitted(found["w"].tolist(), found["y"].to_numpy(dtype=np.int64), found["h"].rank(method="dense").to_numpy(dtype=np.int64))


def likelihoods(net: Network | None, found: list[tuple[str, int, int]]) -> np.ndarray:
    """Probability of each candidate (text, start, end) to be a secret, none without a network."""
    if net is None or not found:
        return np.zeros(len(found))
    return np.concatenate([net.probability(codes([window(*f) for f in found[i : i + 4096]])) for i in range(0, len(found), 4096)])


def spans(text: str, net: Network | None, found: list[tuple[int, int]] | None = None, likely: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then as the kinds are listed, the network's last; it adds no span that a base one covers."""
    base = base_spans(text)
    if found is None:
        found = candidates(text)
        likely = likelihoods(net, [(text, a, b) for a, b in found])
    more: list[tuple[int, int, str]] = []
    for (a, b), p in zip(found, likely):
        if net is None or p < net.threshold or any(s <= a and b <= e for s, e, _ in base):
            continue
        if more and a < more[-1][1]:  # parts of one run
            more[-1] = (more[-1][0], b, METHOD)
        else:
            more.append((a, b, METHOD))
    order = {kind: i for i, (kind, *_) in enumerate(BASE)} | {METHOD: len(BASE)}
    return sorted([*base, *more], key=lambda s: (s[0], order[s[2]], s[1]))


def batch_spans(texts: list[str], net: Network | None) -> list[list[tuple[int, int, str]]]:
    """spans() of many texts, their candidates through the network together."""
    found = [candidates(t) for t in texts]
    if net is None or not any(found):
        return [spans(t, net, f, np.zeros(len(f))) for t, f in zip(texts, found)]
    likely = likelihoods(net, [(t, a, b) for t, f in zip(texts, found) for a, b in f])
    ends = np.cumsum([len(f) for f in found])
    return [spans(t, net, f, likely[e - len(f) : e]) for t, f, e in zip(texts, found, ends)]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """doc_id, counts of each kind, digest of the base spans, all spans as text. A null text counts as empty; one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        for batch in batches:
            for part in by_bytes(batch):
                found = batch_spans(part["text"].to_pylist(), net)
                count = {k: pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in ("assign", "access", "hex", METHOD)}
                digest = [hashlib.sha256(joined([s for s in f if s[2] != METHOD]).encode()).hexdigest() for f in found]
                yield pa.record_batch(
                    [part["doc_id"], count["assign"], count["access"], count["hex"], pa.array(digest), pa.array([joined(f) for f in found]), count[METHOD]],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def masked(text: str, found: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with its spans, overlapping ones as one, replaced by a mark."""
    out, at, upto = [], 0, -1
    for a, b, _ in found:
        if a >= upto:
            out += [text[at:a], mark]
            at = upto = b
        elif b > upto:
            at = upto = b
    return "".join([*out, text[at:]])


def apply(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents with every secret masked, and n_chars, where there is one, that of the new text. Null texts stay null."""
    net = fit(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        for batch in batches:
            for part in by_bytes(batch):
                old = part[text].to_pylist()
                new = [None if t is None else masked(t, f) for t, f in zip(old, batch_spans([t or "" for t in old], net))]
                columns = {n: part[n] for n in part.schema.names}
                columns[text] = pa.array(new, part.schema.field(text).type)
                if size in columns:
                    kept = part[size].to_pylist()
                    columns[size] = pa.array([s if a == b else len(b) for s, a, b in zip(kept, old, new)], part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
