import public_tokenizers
import pytest
from fixtures import docs, rows, sentence

from matchlake.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best(word, scores, worst):
    """Best sum over all ways to cut the word, the longer last piece on ties, by trying them all."""
    unknown = worst - pieces.UNKNOWN_PENALTY
    value, path = [0.0], [[]]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            part = word[start:end]
            if part in scores and (start == 0 or part[0] != pieces.MARK):
                options.append((value[start] + scores[part][1], path[start] + [part]))
        if not any(p[-1] == word[end - 1 : end] for _, p in options):
            options.append((value[end - 1] + unknown, path[end - 1] + [word[end - 1]]))
        top = max(v for v, _ in options)
        value.append(top)
        path.append(next(p for v, p in options if v == top))
    return path[-1]


def test_lattice_equals_all_cuts():
    scores = {p: (i, float(s)) for i, (p, s) in enumerate([("▁", -9), ("▁a", -3), ("a", -4), ("ab", -5), ("b", -4), ("▁ab", -9), ("ba", -2), ("aba", -7), ("c", -4), ("cab", -6.5)])}
    lattice = pieces.Lattice(scores, -9.0)
    words = sorted({"▁" + "".join(w) for n in range(6) for w in __import__("itertools").product("abcx▁", repeat=n)})
    for word, path in zip(words, lattice.paths(words)):
        assert [word[a:b] for a, b, _ in path] == best(word, scores, -9.0), word


def test_order_of_words_does_not_matter():
    table = pieces.Pieces(PATH)
    words = sentence(3, 30).split() + ["", "é", "▁", "thethe"]
    one = [table.encode_flat(__import__("pyarrow").array([w]))[0].tolist() for w in words]
    other = pieces.Pieces(PATH)
    ids, counts = other.encode_flat(__import__("pyarrow").array(words[::-1]))
    ends = counts.cumsum()
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)][::-1] == one


def test_library_agrees_on_unigram():
    """The library's own Viterbi search over the same scores; it differs only where two paths have the same sum."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    table = pieces.Pieces(PATH)
    words = sorted({sentence(i, 3).replace(" ", "")[: 4 + i % 12] for i in range(600)} | {"naïve", "Straße", "日本語", "x\ty"})
    ids, counts = table.encode_flat(__import__("pyarrow").array(words))
    ends = counts.cumsum()
    got = [ids[e - c : e].tolist() for e, c in zip(ends, counts)]
    total = lambda x: sum(library.get_score(i) for i in x if not library.is_byte(i))
    for word, mine, theirs in zip(words, got, library.encode(words)):
        assert mine == theirs or total(mine) >= total(theirs) - 1, word


def test_round_trip_of_rows(spark):
    got = pieces.digests(docs(spark), PATH).collect()
    assert len(got) == 14 and all(r["exact"] for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (4, 5)} == {0}
    encoded = pieces.encode(docs(spark), PATH)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, PATH).collect()}
    assert back == {r[0]: r[1] or "" for r in rows()}
    assert pieces.digests(docs(spark, []), PATH).count() == 0


def test_table_starts_anew(monkeypatch):
    pa = __import__("pyarrow")
    whole = pieces.Pieces(PATH).encode_flat(pa.array([sentence(1, 50)]))[0].tolist()
    monkeypatch.setattr(pieces.Pieces, "kept", 2)
    table = pieces.Pieces(PATH)
    for _ in range(3):
        assert table.encode_flat(pa.array([sentence(1, 50)]))[0].tolist() == whole


SPACED = ["    if x:\n        return  y", "  a  b   c ", " ", "   ", "a" + " " * 40 + "b", "x  ", "| a  |  b   |", "", "plain words", "▁▁  ▁"]


def encoded(table, texts):
    ids, counts = table.encode_flat(__import__("pyarrow").array(texts))
    ends = counts.cumsum()
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


def spaced_model(tmp_path, scores):
    """The vocabulary as a unigram one, with these scores for runs of spaces."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.piece.strip("▁") == "" and len(piece.piece) in scores:
            piece.score = scores[len(piece.piece)]
    path = str(tmp_path / "spaced.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("scores", [{}, {2: -3.5, 3: -6.25, 4: -4.75, 8: -5.5, 16: -1.0}])
def test_runs_of_spaces_equal_the_library(tmp_path, scores):
    """Best paths through runs of spaces, with the scores that are in the file and with such that make long runs the best."""
    from sentencepiece import SentencePieceProcessor

    path = spaced_model(tmp_path, scores)
    library, table = SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    total = lambda x: sum(library.get_score(i) for i in x if not library.is_byte(i))
    for text, mine in zip(SPACED, encoded(table, SPACED)):
        assert table.decode(mine) == text
        theirs = library.encode(text)
        if "▁" not in text:
            assert mine == theirs or (len(mine) == len(theirs) and abs(total(mine) - total(theirs)) < 1e-3), text
    if scores:
        assert len(encoded(table, ["a" + " " * 40 + "b"])[0]) <= 6
    assert encoded(table, SPACED) == [encoded(pieces.Pieces(path), [t])[0] for t in SPACED]
