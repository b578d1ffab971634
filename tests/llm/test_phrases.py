import random
import re
from collections import Counter

import pyarrow as pa
from fixtures import docs, rows

from matchlake.llm import phrases


def plain(some, support, share=80, most=2000):
    """The contract by counting everything: rows (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in some:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    frequent = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= support}
    out = {}
    for (lang, p), a in frequent.items():
        holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(g == lang and len(q) > len(p) and holds(q) and 100 * v >= share * a for (g, q), v in frequent.items()):
            continue
        cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        k = cut[1]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most])
    )


def made(seed, n, size=60):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "a", "ünd", "x1", "new", "york", "big", "city", "\U0001F600"]
    marks = [" "] * 12 + [", ", ".\n", "\t", "? ", " ; "]
    out = []
    for i in range(n):
        text = "".join((rng.choice(vocabulary) if rng.random() < 0.6 else "new york city hall") + rng.choice(marks) for _ in range(rng.randrange(size)))
        out.append((rng.choice([i, i, 1, None]), text, rng.choice(["en", "en", "en", "de", None]), None, 0))
    return out


def test_against_counting_everything(spark):
    some = made(1, 120) + [r[:5] for r in rows()]
    for support, share, most in ((4, 80, 2000), (9, 60, 5)):
        got = phrases.collocations(docs(spark, some), support=support, inside_share=share, most=most).collect()
        assert sorted(map(tuple, got)) == plain(some, support, share, most)
        assert got


def test_repeated_documents_in_one_shard_count_as_often_as_they_are_there(spark):
    some = [(1, "alpha beta gamma", "en", None, 0)] * 30 + [(2, "Alpha beta", "en", None, 0)] * 29
    assert sorted(map(tuple, phrases.collocations(docs(spark, some)).collect())) == plain(some, 30)


def test_nothing_frequent_and_no_rows(spark):
    assert phrases.collocations(docs(spark), support=10_000).count() == 0
    assert phrases.collocations(docs(spark, [])).count() == 0


def test_chunks_count_as_the_whole(monkeypatch):
    """Cuts inside texts, between texts, at gaps and at line ends: every phrase is counted once."""
    texts = [t for _, t, *_ in made(3, 40, 200)] + ["one\n" * 500, "", ".", "a  b\t c " + "long" * 9 + "x y " + "long" * 9 + "z y", " " * 300, "...\n" * 80]
    langs = [("en", "de", "und")[i % 3] for i in range(len(texts))]
    batch = pa.record_batch([pa.array(texts), pa.array(langs), pa.array([i % 5 for i in range(len(texts))], pa.int32())], names=["text", "lang", "shard"])
    everything = phrases.Filter(phrases.np.full(1024, 2**64 - 1, dtype=phrases.np.uint64))

    def counted():
        out, chunks = Counter(), 0
        for names, chunk in phrases._chunks(batch):
            chunks += 1
            held = {}
            phrases._exact(names, chunk, everything, held)
            for part in phrases._rows(held):
                out.update({(r["lang"], r["n"], r["phrase"]): r["times"] for r in part.to_pylist()})
        return out, chunks

    whole, one = counted()
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    parts, many = counted()
    assert one == 1 and many > 50 and parts == whole


def test_filters_hold_what_was_put_in(spark):
    keys = [phrases.xxhash.xxh3_64_intdigest(str(i)) for i in range(5000)]
    signed = [k - 2**64 if k >= 2**63 else k for k in keys]
    made_ = phrases.filter_of(spark.createDataFrame([(k,) for k in signed], "key long"))
    assert made_.holds(phrases.np.array(keys, dtype=phrases.np.uint64)).all()
    others = phrases.np.array([phrases.xxhash.xxh3_64_intdigest(f"x{i}") for i in range(5000)], dtype=phrases.np.uint64)
    assert made_.holds(others).mean() < 0.1
    assert not phrases.filter_of(spark.createDataFrame([], "key long")).holds(others).any()
