import gc
import os
import threading

import numpy as np
import pytest
from pyspark.sql import types as T

from matchlake.llm import embedding_dups as ed

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType())])


def plain(some, cosine):
    live = [v if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v in some]
    x = [None if v is None else np.array(v, dtype=np.float32).astype(float) for v in live]
    n, top = [0] * len(some), list(range(len(some)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(some)):
        for j in range(i):
            if x[i] is None or x[j] is None or len(x[i]) != len(x[j]):
                continue
            if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                n[i] += 1
                n[j] += 1
                top[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(some):
        ids = [e for k, (e, _) in enumerate(some) if find(k) == find(i)]
        out.append((d, n[i], min(ids), min(ids) == d))
    return out


def vectors(seed=0, size=32, groups=20, n=9):
    rng = np.random.default_rng(seed)
    out, d = [], 0
    for g in range(groups):
        base = rng.normal(size=size)
        for k in range(n):
            noise = rng.normal(size=size) * np.linalg.norm(base) / np.sqrt(size)
            v = base if k < 2 else base + noise * (0.05, 0.2, 0.42, 0.55, 1.0)[k % 5]
            out.append((d, v.astype(np.float32).tolist()))
            d += 1
    return out


def test_links_equal_all_pairs(spark):
    some = vectors()
    some += [(900, None), (901, []), (902, [0.0] * 32), (903, [1.0] * 31 + [float("nan")]), (904, [float("inf")] * 32), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [None] * 32), (908, some[0][1])]
    df = spark.createDataFrame([(*r, 1, "c") for r in some], SCHEMA)
    got = {r["vec_id"]: tuple(r) for r in ed.near_duplicates(df, 0.9).collect()}
    want = plain(some, 0.9)
    assert len(got) == len(some)
    assert all(got[w[0]][1] <= w[1] for w in want)  # none below the threshold
    assert sum(g[1] for g in got.values()) >= 0.98 * sum(w[1] for w in want)
    sure = [w for w in want if got[w[0]][1] == w[1]]
    assert len(sure) >= 0.95 * len(want)
    assert got[908][1] == next(w[1] for w in want if w[0] == 908)
    assert got[905][1:] == (1, 905, True) and got[906][1:] == (1, 905, False) and got[900][1:] == (0, 900, True)


def test_one_dense_group_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 20)
    some = vectors(3, 16, 1, 2)
    rng = np.random.default_rng(1)
    base = np.array(some[0][1])
    some += [(10 + i, (base + rng.normal(size=16) * 0.02).astype(np.float32).tolist()) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "c") for r in some], SCHEMA)
    got = sorted(map(tuple, ed.near_duplicates(df, 0.9).collect()))
    assert got == sorted(plain(some, 0.9))


@pytest.mark.parametrize("size", [2, 64])
def test_calibration_is_held(size):
    plan = ed.calibrate(size, 20_000, 0.9)
    rng = np.random.default_rng(99)
    x = rng.normal(size=(800, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(0.19) * z
    (ka, va), (kb, vb) = plan.entered(x, plan.spaces()), plan.entered(y, plan.spaces())
    same, far = ed._shared(ka, va, kb, vb)
    assert ((same & (far <= plan.window)).sum(axis=(1, 2)) >= plan.collisions).mean() >= 0.98 or size == 2


def test_no_rows_and_repeats(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (1, [1.0, 2.0], 0, ""), (2, [-1.0, 2.0], 0, "")], SCHEMA)
    assert sorted(map(tuple, ed.near_duplicates(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_disk_follows_the_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ed, "PASS_BYTES", 0, raising=False)  # as with many more vectors
    x = np.random.default_rng(5).normal(size=(12_000, 64)).astype(np.float32)
    x[:300] = x[300] + 0.3 * x[:300]  # cosines around 0.9 and above
    path = str(tmp_path / "embeddings")
    spark.createDataFrame([(i, v, 1, "c") for i, v in enumerate(x.tolist())], SCHEMA).repartition(4).write.parquet(path)
    shuffled = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    monkeypatch.setattr(ed, "written", lambda df, name, f=ed.written: placed(f(df, name)))
    kept, most, done = set(), [0], threading.Event()

    def placed(df):
        kept.update(f.removeprefix("file:") for f in df.inputFiles())
        return df

    def size(path):
        try:
            return os.path.getsize(path)
        except OSError:  # it has gone meanwhile
            return 0

    def used():
        return sum(size(os.path.join(d, f)) for top in shuffled for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")) + sum(map(size, kept))

    def watch():
        while not done.wait(0.02):
            most[0] = max(most[0], used() - before)

    gc.collect()
    before = used()
    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = ed.near_duplicates(spark.read.parquet(path), 0.9).select("vec_id", "n_links").collect()
    finally:
        done.set()
        thread.join()
    assert most[0] <= 4 * x.nbytes
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = sum(int((unit[i : i + 1000] @ unit.T >= 0.9).sum()) for i in range(0, len(x), 1000)) - len(x)
    assert want > 1000 and 0.98 * want <= sum(r["n_links"] for r in got) <= want


def test_parts_blocks_and_passes_count_each_link_once(spark, monkeypatch):
    for name, value in (("TASK_ENTRIES", (60, 120)), ("BLOCK", 60), ("PASS_BYTES", 0), ("LIST_LENGTH", 40), ("DEAL_BYTES", 20_000), ("TILE", (16, 32))):
        monkeypatch.setattr(ed, name, value, raising=False)
    monkeypatch.setattr(ed, "_BELOW", np.tri(16, dtype=bool), raising=False)
    some = vectors(7, 24, 12, 30)
    base = np.array(some[0][1])
    some += [(500 + i, (base * (1 + i) + np.linalg.norm(base) * (1 + i) * np.random.default_rng(i).normal(size=24) * 0.05).tolist()) for i in range(90)]
    some += [(700 + i, some[i][1]) for i in range(0, 40, 3)]
    found = []
    monkeypatch.setattr(ed, "_layouts", lambda *a, f=ed._layouts: found.append(f(*a)) or found[-1])
    for kind in (T.FloatType(), T.DoubleType()):
        df = spark.createDataFrame([(d, np.array(v, dtype=np.float32).astype(float).tolist()) for d, v in some], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind))]))
        got, want = sorted(map(tuple, ed.near_duplicates(df, 0.9).collect())), sorted(plain(some, 0.9))
        assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link twice
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
        layout = found.pop()[24]
        assert layout.passes > 1 and len(layout.hot) and layout.blocks.max() > 1 and layout.parts.max() > 1
