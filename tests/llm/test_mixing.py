import re

import pytest
from fixtures import docs, rows

from matchlake.llm import mixing


def plain_targets(sizes):
    """Share by weight, cut what is above three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {s: 0.0 for s in order}, set(order), float(sum(sizes.values()))
    while left > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(free):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.remove(s)
    return target


def test_mix_meets_targets(spark):
    got = mixing.mix(docs(spark)).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows())}
    sizes = {}
    for i, r in enumerate(rows()):
        sizes[r[3]] = sizes.get(r[3], 0) + words[i]
    want = plain_targets(sizes)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] or 0, words[i]) for i, r in enumerate(rows()))
    of = {}
    for r in rows():
        of.setdefault(r[0], r[3])
    for s, size in sizes.items():
        mine = [r for r in got if of[r["doc_id"]] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


@pytest.mark.parametrize("sizes", [[1, 1, 1], [100, 1, 1, 1000], [5, 0, 0, 7], [1, 2, 3, 4, 5, 6, 7], [0], [10**9, 1]])
def test_targets(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    df = spark.createDataFrame(list(named.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(named)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in named)


def test_apply_repeats_and_drops(spark):
    df = docs(spark)
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = mixing.apply(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert got == {k: v for k, v in taken.items() if v}


def test_no_rows(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.apply(docs(spark, [])).count() == 0


def test_rows_that_share_an_id_alone_are_not_taken_alike(spark):
    """A source whose ids are all null, and one that has one id only, come as near to their targets as any other."""
    some = [(None, f"{'w ' * (1 + i % 7)}n{i}", "en", "none", 0) for i in range(300)] + [(7, f"{'v ' * (1 + i % 5)}o{i}", "en", "one", 0) for i in range(300)]
    some += [(100 + i, f"own {i}", "en", "own", 0) for i in range(300)]
    got = mixing.mix(docs(spark, some)).collect()
    for size in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 8
