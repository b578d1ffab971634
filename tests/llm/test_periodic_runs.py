import hashlib
import random
import re
import zlib

from fixtures import docs, rows

from matchlake.llm import periodic_runs as runs, queries


def plain_runs(w):
    """Every period by comparing each word with the one a period later; the smallest period of a stretch counts."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_rest(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rng, most=150):
    w = []
    while rng.random() < 0.9 and len(w) < most:
        if rng.random() < 0.5:
            p = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            w += (p * rng.randrange(1, 9))[: rng.randrange(1, 45)]
        else:
            w += [rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))]
    return w


def test_runs_are_those_of_every_period():
    rng = random.Random(11)
    for _ in range(600):
        texts = [made(rng) for _ in range(rng.randrange(1, 6))]
        got = runs.runs_of([" ".join(w).encode() for w in texts])
        for w, found in zip(texts, got):
            assert found == plain_runs(w)
            assert runs.collapsed(("\t".join(w) + " \n").encode(), found).decode() == plain_rest(w, found)


def test_neighbouring_texts_do_not_meet():
    assert runs.runs_of([b"a a a", b"a a a", b"", b"a a a a a a"]) == [[], [], [], [(0, 6, 1)]]


def test_shortest_and_nested_runs():
    text = "a a a a a b a a a a a b a a a a a b a a a a a b c"
    assert runs.runs_of([text.encode()])[0] == plain_runs(text.split()) == [(0, 24, 6)]
    assert runs.runs_of([b"x y x y x y x", b"x y x y x y x y"]) == [[], [(0, 8, 2)]]


def test_very_long_texts():
    """Half a million words: one word only, two at random, and a long period, in parts of a text each."""
    rng = random.Random(5)
    period = [str(i) for i in range(50_000)]
    texts = [b"a " * 500_000, " ".join(rng.choice("ab") for _ in range(100_000)).encode(), " ".join(period * 5).encode()]
    got = runs.runs_of(texts)
    assert got[0] == [(0, 500_000, 1)] and got[2] == [(0, 250_000, 50_000)]
    assert got[1] and all(n >= max(6, 4 * q) for _, n, q in got[1])
    assert runs.collapsed(texts[0], got[0]) == b"a" and runs.collapsed(texts[2], got[2]) == " ".join(period).encode()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_query_against_the_plain_version(spark):
    """Documents with their repeats by the contract's own words, and the digests; nulls, empty texts and repeated ids too."""
    rng = random.Random(2)
    some = [(i, " ".join(made(rng, 400)), None, None, 0) for i in range(200)] + [r[:5] for r in rows()]
    got = runs.digests(runs.find(queries.with_repeats(docs(spark, some)))).collect()
    assert len(got) == len(some)
    wanted = []
    for doc, text, *_ in some:
        w = words(text)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        wanted.append((doc, len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(plain_rest(w, found))))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(200)) > 10


def test_empty_table(spark):
    assert runs.digests(runs.find(queries.with_repeats(docs(spark, [])))).count() == 0
