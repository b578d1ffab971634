import numpy as np
import pyarrow as pa
from fixtures import docs, rows, sentence

from matchlake.llm import quality


def labelled(spark, n=240):
    some, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(i, 50) + "."
        if bad:
            text = " ".join(w + ("###", "$$$", "&&&")[j % 3] for j, w in enumerate(text.split())) if i % 8 else text.upper().replace(" ", "!! ")
        some.append((i, text, ("en", "fr")[i % 2], f"src{i % 5}", len(text)))
        if i % 3:
            marks.append((i, int(not bad)))
    return docs(spark, some), spark.createDataFrame(marks, "doc_id long, quality int"), {i: i % 4 != 0 for i in range(n)}


def test_held_out_accuracy(spark):
    df, marks, truth = labelled(spark)
    got = quality.score(df, quality.fit(df, marks)).collect()
    assert len(got) == len(truth)
    unseen = [r for r in got if r["doc_id"] % 3 == 0]
    assert np.mean([r["kept"] == truth[r["doc_id"]] for r in unseen]) >= 0.97
    assert all(0 <= r[c] <= 1 for r in got for c in ("p_text", "p_page", "p_good"))


RARE = "casino jackpot bonus spins wager roulette payout blackjack".split()


def taught(spark):
    """300 labelled documents, whose sources say nothing, and 12,000 others: of the source `dump`, which no label knows, all are
    bad, nearly all by their marks, and 40 by words that no label knows either."""
    rng = np.random.default_rng(6)
    some, marks = [], []

    def marked(text):
        return " ".join(w + ("###", "$$$", "&&&")[j % 3] for j, w in enumerate(text.split()))

    for i in range(12_300):
        text, source = sentence(i, 25) + ".", ("a", "b", "c")[i // 3 % 3]
        bad = i % 3 == 0 if i < 300 else i % 3 == 1
        if i < 300:
            marks.append((i, int(not bad)))
        elif bad:
            source = "dump"
        if bad:
            text = " ".join(rng.choice(RARE, 25)) + "." if i >= 300 and i % 300 == 1 else marked(text)
        some.append((i, text, "en", source, len(text)))
    return docs(spark, some), spark.createDataFrame(marks, "doc_id long, quality int")


def test_views_teach_each_other_what_no_label_knows(spark):
    """The text view knows the marks and tells the page view of the source; that one tells the text view of the rare words."""
    df, marks = taught(spark)
    views = quality.fit(df, marks)
    fresh = docs(spark, [(1, " ".join(RARE * 3) + ".", "en", "a", 200), (2, sentence(77_777, 25) + ".", "en", "dump", 150), (3, sentence(88_888, 25) + ".", "en", "a", 150)])
    got = {r["doc_id"]: r for r in quality.score(fresh, views).collect()}
    assert got[1]["p_text"] < 0.5 < got[3]["p_text"] and got[2]["p_page"] < 0.5 < got[3]["p_page"]


def test_handed_over_rows_are_the_surest_of_all_and_spread(spark):
    """Of 20,000 scored rows; the few that the taker thinks otherwise of are all there, the many are drawn from and weigh more."""
    rows = [(i, 6.0 if i % 2 else -6.0, (4.0 if i < 30 else -4.0) if i % 2 == 0 else 0.0, 1) for i in range(20_000)]
    scored = spark.createDataFrame(rows, "h long, t float, p float, n long")
    given = [r for r in quality.handed_over(scored, 0.5, 0.5).collect() if r["taker"] == "page"]
    assert all((r["h"] % 2 == 1) == (r["label"] == 1) for r in given)
    bad = [r for r in given if r["label"] == 0]
    few = [r for r in bad if r["h"] < 30]
    assert len(few) == 15 and all(r["weight"] == 1.0 for r in few)
    assert 200 <= len(bad) - 15 <= 400 and all(r["weight"] > 4 for r in bad if r["h"] >= 30)
    assert quality.handed_over(scored.where("abs(t) < 1 AND abs(p) < 1"), 0.5, 0.5) is None
    text = [r for r in quality.handed_over(scored, 0.5, 0.5).collect() if r["taker"] == "text"]
    assert {r["h"] for r in text if r["label"] == 1} == set(range(0, 30, 2))


def test_apply_keeps_columns_and_good_documents(spark):
    df, marks, truth = labelled(spark)
    out = quality.apply(df, marks)
    assert out.columns == df.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert all(d in kept for d, good in truth.items() if good)
    assert len(kept) <= sum(truth.values()) + 3


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    for marks in (none, nulls):
        assert quality.score(docs(spark), quality.fit(docs(spark), marks)).count() == 14
        assert quality.apply(docs(spark), marks).count() == 14
    assert quality.apply(docs(spark, []), none).count() == 0


def test_same_samples_give_the_same_scores(spark):
    df, marks, _ = labelled(spark)
    a = quality.score(df, quality.fit(df, marks)).orderBy("doc_id").collect()
    b = quality.score(df.repartition(3), quality.fit(df.repartition(3), marks)).orderBy("doc_id").collect()
    assert all(abs(x["p_good"] - y["p_good"]) < 1e-9 for x, y in zip(a, b))


def test_vocabulary_alone_tells_bad_from_good(spark):
    """Bad documents have the same punctuation, capitals, word lengths and lines as good ones; only their words differ."""
    rng = np.random.default_rng(4)
    swap = str.maketrans("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm")
    words = sentence(1, 400).split()
    some, marks = [], []
    for i in range(300):
        text = " ".join(rng.choice(words, 40)) + "."
        bad = i % 3 == 0
        some.append((i, text.translate(swap) if bad else text, "en", "s", len(text)))
        if i < 200:
            marks.append((i, int(not bad)))
    df = docs(spark, some)
    got = quality.score(df, quality.fit(df, spark.createDataFrame(marks, "doc_id long, quality int"))).where("doc_id >= 200").collect()
    assert np.mean([(r["p_text"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in got]) >= 0.97


def words_of(text):
    found = quality.text_features([text.encode()])[0]
    return set(np.flatnonzero(found[quality.SHAPE_DIMS : quality.SHAPE_DIMS + quality.WORD_DIMS]).tolist())


def test_word_hashes_depend_on_letters_and_not_on_places():
    assert words_of("abc") == words_of("xy Abc") - words_of("xy") and words_of("abc") != words_of("bca") and not words_of("")
    assert words_of("a" * 30 + "b" + "c" * 30) == words_of("z " + "a" * 30 + "b" + "c" * 30) - words_of("z")


def test_features_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    texts = [r[1] or "" for r in rows()] + ["a\n", "\n\n", "x" * 500, "Ab. Cd!\nEf? g|h ##\n" * 7]
    raw = [t.encode() for t in texts]
    together = quality.text_features(raw)
    assert np.isfinite(together).all()
    for i, t in enumerate(raw):
        assert np.allclose(quality.text_features([t])[0], together[i], atol=1e-6)
    line = quality.text_features([b"Ab. Cd!\nEf? g|h ##\nEf? g|h ##\n"])[0]
    assert np.isclose(line[12], 3 / 4) and np.isclose(line[13], 1 / 4) and np.isclose(line[14], 3 / 4)  # distinct, closed, begun large
    # Parts of a long text add up; only distinct words and lines are counted for each part.
    long = (sentence(3, 3000) + "\n").encode()
    whole = quality.text_features([long])[0]
    monkeypatch.setattr(quality, "PART_BYTES", 1000)
    parts = quality.text_features([b"x", long, b"y"])[1]
    near = np.abs(whole - parts)
    assert near[quality._SUMS :].max() < 0.02 and near[0] < 1e-6


def test_a_repeated_labelled_id_brings_one_row(spark):
    """A doc_id that very many rows share gives the fit one of them."""
    some = [(1, sentence(i, 5), "en", "s", 5) for i in range(500)] + [(2, "### " * 9, "en", "s", 5)]
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").selectExpr("doc_id", "'' AS taker", "quality AS label", "1.0D AS weight")
    assert quality._examples_of(quality._inputs(docs(spark, some), "text"), marks, "doc_id").count() == 2


def test_features_are_laid_out_in_small_joint_steps(monkeypatch):
    texts = [(sentence(i, 400) + "\n").encode() * (1 + i % 3) for i in range(500)]
    whole, sizes, counts = quality.text_features(texts), [], quality._counts
    monkeypatch.setattr(quality, "_counts", lambda parts: sizes.append(sum(map(len, parts))) or counts(parts))
    assert quality.text_features(texts).tobytes() == whole.tobytes()
    assert sum(sizes) > 1 << 20 and max(sizes) <= 1 << 19
    monkeypatch.setattr(quality, "JOINT_BYTES", 1 << 23, raising=False)
    assert quality.text_features(texts).tobytes() == whole.tobytes()
    # A text beyond the bound is one step as before.
    assert quality.text_features([b"a b " * 200_000])[0, 0] == np.float32(np.log1p(800_000) / 10)


def test_fit_does_not_depend_on_the_order_of_its_rows():
    rng = np.random.default_rng(3)
    some = [sentence(i, 30) + (" ### $$$" if i % 2 else "") for i in range(120)]
    packed = [quality._packed(x) for x in quality.text_features([t.encode() for t in some])]
    pages = [x.tobytes() for x in quality.page_features(["en"] * 120, [f"s{i % 3}" for i in range(120)], list(range(120)))]
    kinds = {"key": pa.int64(), "taker": pa.string(), "label": pa.int32(), "weight": pa.float64(), "xt": pa.binary(), "xp": pa.binary()}
    columns = [list(range(120)), ["" if i < 90 else ("text", "page")[i % 2] for i in range(120)], [i // 2 % 2 for i in range(120)], [1.0] * 120, packed, pages]
    rows = pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))
    shuffled = rows.take(rng.permutation(120))
    first, again = quality._fitted(rows), quality._fitted(shuffled)
    assert np.array_equal(first.text.weights, again.text.weights) and np.array_equal(first.joint, again.joint) and first.keep_from == again.keep_from
