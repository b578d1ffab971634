import re

import numpy as np
import pytest
from fixtures import docs, rows, sentence

from matchlake.llm import graph, near_dups


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def plain_components(some, percent):
    """All pairs of rows."""
    sets = [plain_set(r[1]) for r in some]
    top = list(range(len(some)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(some)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, r in enumerate(some):
        ids = [x[0] for n, x in enumerate(some) if find(n) == find(i) and x[0] is not None] if sets[i] else [r[0]]
        out.append((r[0], len(sets[i]), min(ids, default=None), min(ids, default=None) == r[0]))
    return out


def edited(text, every, seed):
    words = text.split()
    for i in range(seed % every, len(words), every):
        words[i] = f"w{seed}x{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def some():
    out = [r[:4] for r in rows()]
    n = 100
    for family in range(6):
        base = sentence(family * 31, 90 + 60 * family)
        for k in range(9):
            out.append((n, edited(base, (400, 150, 90, 60, 40)[k % 5], k + 1) if k else base, "en", "a"))
            n += 1
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_all_pairs(spark, some, percent, monkeypatch):
    got = near_dups.near_duplicates(docs(spark, some), percent).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_components(some, percent), key=key)


def test_large_group_in_small_blocks(spark, monkeypatch):
    """A chain of versions, each close to the next only, over many blocks, with a small sketch and joins instead of broadcasts."""
    monkeypatch.setattr(near_dups, "BLOCK_CLASSES", 7)
    monkeypatch.setattr(near_dups, "BROADCAST_ROWS", 0)
    words = sentence(77, 300).split()
    chain = []
    for i in range(60):
        words = [*words[:i], f"v{i}", *words[i + 1 :]] if i % 2 else words
        chain.append((500 + i, " ".join(words), None, None))
    got = near_dups.near_duplicates(docs(spark, chain), 85, k=32).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(chain, 85))


def test_overlap_bound_holds_for_small_sets():
    rng = np.random.default_rng(2)
    for _ in range(4000):
        k, union = 8, rng.integers(1, 14)
        values = np.arange(union)
        rng.shuffle(values)
        a, b = set(values[rng.random(union) < 0.93].tolist()), set(values[rng.random(union) < 0.93].tolist())
        if not a or not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        kept = len(set(sorted(a)[:k]) & set(sorted(b)[:k]))
        for s in (a, b):
            if len(s) <= k:
                assert kept >= near_dups.least_overlap(len(s), 0.85, k)


def test_apply_keeps_one_of_each_group(spark, some):
    df = docs(spark, some)
    out = near_dups.apply(df, 85)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    want = plain_components(some, 85)
    firsts = {w[0] for w in want if w[3]}
    assert {d for d, _ in got} == {str(d) for d in firsts}
    assert len([d for d, _ in got if d == "7"]) == 0 and len([d for d, _ in got if d == "6"]) == 1
    assert len(got) == len(set(got)) == len({w[2] for w in want})


def test_no_rows(spark):
    assert near_dups.near_duplicates(docs(spark, [])).count() == 0 and near_dups.apply(docs(spark, [])).count() == 0


def test_graph_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(50)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stage_takes_pairs_between_80_and_85(spark):
    """Two words of a hundred differ: 86 of 106 shingles in common, 0.811."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    other = [w + "x" if i in (30, 60) else w for i, w in enumerate(words)]
    third = [w + "y" if i in (20, 50, 80) else w for i, w in enumerate(words)]  # 81 of 111 with the first
    df = docs(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(third))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, df, "").collect()) == [1, 3]
    assert near_dups.near_duplicates(df, 85).where("kept").count() == 3
