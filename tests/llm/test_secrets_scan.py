import hashlib
import re

import numpy as np
import pytest
from fixtures import docs, rows, sentence

from matchlake.llm import secrets_scan as scan


def plain(text):
    """Each pattern as it stands, over the whole text."""
    kinds = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
    )
    out = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    parts = ["a1", "deadbeef", "0123456789", "token", "API_KEY", "apikey", " ", "=", ": ", '"', "'", "AKIA", "ABCDEF123456", "xyz+/=", "é", "ſecret", "toKen", "passwd", "-", "_.", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 22)))
        assert scan.base_spans(text) == plain(text)


def key(rng, n=40, letters="0123456789abcdef"):
    return "".join(rng.choice(list(letters), n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    return [sentence(i, 30) + (f' token = "{key(rng)}" ' if i % 3 == 0 else f" {rng.integers(10**15, 10**16)} see_this_long_name_{i} ") + sentence(i + 999, 30) for i in range(240)]


@pytest.fixture(scope="module")
def net(texts):
    return scan.fitted(*scan.examples(texts))


def test_network_finds_unseen_kinds(net):
    rng = np.random.default_rng(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = 0
    for i in range(60):
        text = sentence(i, 10) + f' auth = "{key(rng, 40, letters)}" ' + sentence(i + 7, 10)
        found += any(k == scan.METHOD for _, _, k in scan.spans(text, net))
    assert found >= 54
    wrong = sum(any(k == scan.METHOD for _, _, k in scan.spans(sentence(i, 20) + " some_plain_long_words_here_1 " + sentence(i, 9), net)) for i in range(60))
    assert wrong <= 6


def test_base_spans_stay(net, texts):
    for text in texts[:40]:
        got = scan.spans(text, net)
        assert [s for s in got if s[2] != scan.METHOD] == plain(text)
        assert got == scan.batch_spans([text, ""], net)[0]


def test_query_rows(spark, net):
    got = sorted(scan.scan(docs(spark), net).collect(), key=lambda r: str(r["doc_id"]))
    assert len(got) == 14
    nine = next(r for r in got if r["doc_id"] == 9)
    want = plain(rows()[9][1])
    assert (nine["n_assign"], nine["n_access"], nine["n_hex"]) == (1, 0, 1)
    assert nine["base_sha256"] == hashlib.sha256(scan.joined(want).encode()).hexdigest()
    empty = next(r for r in got if r["doc_id"] == 4)
    assert empty["spans"] == "" and empty["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_apply_masks(spark):
    df = docs(spark)
    out = scan.apply(df)
    assert out.columns == df.columns and out.count() == 14
    nine = out.where("doc_id = 9").first()
    assert nine["text"] == 'x [secret]" y' and nine["n_chars"] == len(nine["text"])
    assert out.where("doc_id = 4").first()["text"] is None
    assert out.where("doc_id = 1").first()["n_chars"] == df.where("doc_id = 1").first()["n_chars"]
    assert scan.apply(docs(spark, [])).count() == 0


def test_fit_from_rows(spark, texts):
    df = docs(spark, [(i, t) for i, t in enumerate(texts)])
    a, b = scan.fit(df), scan.fit(df.repartition(3))
    assert a.threshold == b.threshold and np.array_equal(a.out, b.out)


def test_masked_joins_overlaps():
    assert scan.masked("0123456789", [(1, 3, "hex"), (2, 5, "cnn"), (7, 8, "hex")]) == "0[secret]56[secret]89"


def test_key_in_the_middle_of_a_long_run(net):
    """The span holds most of the key and not the whole run; short keys are candidates too."""
    rng = np.random.default_rng(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = wide = 0
    for i in range(40):
        path = sentence(i, 60).replace(" ", "/")
        made = key(rng, 40, letters)
        text = f"see {path[:80]}/{made}/{path[90:170]} here"
        got = [(a, b) for a, b, k in scan.spans(text, net) if k == scan.METHOD]
        at = text.index(made)
        found += sum(max(0, min(b, at + 40) - max(a, at)) for a, b in got) >= 30
        wide += any(b - a > 160 for a, b in got)
    assert found >= 34 and wide <= 6
    assert scan.candidates('auth = "aB3dE5gH7jK9mN"') == [(8, 22)]
