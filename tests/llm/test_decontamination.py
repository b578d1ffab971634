import re

import pytest
from fixtures import docs, rows, sentence

from matchlake.llm import decontamination as dec

ITEMS = [
    (1, sentence(2, 25).upper() + "?"),
    (2, "Box, vex!"),
    (3, sentence(2, 14) + " é\U0001F600x"),
    (3, "..."),
    (4, None),
    (5, ""),
    (None, sentence(5, 30)),
    (6, sentence(1, 60)),
    (6, sentence(1, 60)),
]


def words(text):
    return list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)})))


def plain(text, items):
    """n_words, hit words, item ids, by comparing every window with every place."""
    own = [m.group() for m in words(text)]
    hit, ids = set(), set()
    for item, t in items:
        w = [m.group() for m in words(t)]
        m = min(10, len(w))
        for i in range(len(w) - m + 1) if m else ():
            for j in range(len(own) - m + 1):
                if own[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    ids |= {item} - {None}
    return len(own), sorted(hit), sorted(ids)


@pytest.mark.parametrize("automaton_words", [dec.AUTOMATON_WORDS, 40])
def test_against_every_window_at_every_place(spark, automaton_words):
    """Odd rows, items beside each other, at the ends, in other letters; with one automaton and with several."""
    some = rows() + [
        (20, "x " + sentence(2, 25).replace(" ", "\n-- ") + " y " + sentence(2, 12), "en", "a", 1, *[None] * 4),
        (21, sentence(2, 9) + " zz box  vex", "en", "a", 1, *[None] * 4),
        (21, sentence(2, 9) + " zz box  vex", "en", "a", 1, *[None] * 4),
        (22, "ünë " + sentence(2, 14) + " É\U0001F600x é\U0001F600x.", "en", "a", 1, *[None] * 4),
    ]
    marks = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dec.scan(docs(spark, some), marks, automaton_words=automaton_words).collect()
    assert len(got) == len(some)
    texts = {r[0]: r[1] for r in some}
    for r in got:
        n, hit, ids = plain(texts[r["doc_id"]], ITEMS)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), ids)
        covered = [i for s in r["spans"] for i in range(s["first"], s["after"])]
        assert covered == hit
        places = words(texts[r["doc_id"]])
        for s in r["spans"]:
            assert (s["start"], s["end"]) == (places[s["first"]].start(), places[s["after"] - 1].end())
    assert any(len(r["spans"]) > 1 for r in got) and any(r["items"] == [2] for r in got)


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = dec.digests(dec.scan(docs(spark), none)).collect()
    assert len(out) == len(rows()) and not any(r["contaminated"] or r["n_items"] for r in out)
    assert dec.scan(docs(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_long_items_and_texts(spark):
    """An item of several pieces inside a text of a million words: every window of it is found, across the pieces too."""
    item = " ".join(f"w{i}" for i in range(2 * dec.PIECE_WORDS + 5))
    text = "a b c " * 300_000 + item + " d" * 100_000
    marks = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = dec.scan(docs(spark, [(1, text, None, None, 0)]), marks).first()
    assert (r["n_hit"], r["items"]) == (2 * dec.PIECE_WORDS + 5, [7]) and len(r["spans"]) == 1
    assert text[r["spans"][0]["start"] : r["spans"][0]["end"]] == item


def test_item_ids_are_sorted_as_strings(spark):
    import hashlib

    marks = spark.createDataFrame([(10, "one two"), (9, "one two")], "item_id long, text string")
    r = dec.digests(dec.scan(docs(spark, [(1, "One two", None, None, 0)]), marks)).first()
    assert r["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and r["n_items"] == 2
