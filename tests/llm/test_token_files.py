import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import docs, rows
from tokenizers import Tokenizer

from matchlake.llm import bpe, token_files
from matchlake.session import new_work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_pieces_encode_as_the_whole_text(library):
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "a", "b1", "'s", "é", "　", "\xa0", ".", "<|endoftext|>", " a", "日本", "\r\n", "\x85", "\x1c"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in bpe.Encoder(PATH).encode(texts)] == [library(t) for t in texts]


def test_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "kept", 3)
    e = bpe.Encoder(PATH)
    for text in ("a b c d e", "a x y z", "", "  q", "a b c d e"):
        assert e.encode([text])[0].tolist() == library(text)


def test_files_hold_all_ids_in_order(spark, library):
    path = new_work_dir(spark, "tokens") + "/orc"
    token_files.write(docs(spark), path, PATH, 2)
    got = token_files.digests(spark, path).collect()
    want, at = [], 0
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    for r in order:
        ids = library(r[1] or "") + [2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    found = token_files.find(spark, path, [3]).collect()
    assert [r["ids"] for r in found] == [library(rows()[2][1]) + [2]]
    plan = token_files.find(spark, path, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(doc_id,3)" in plan or "In(doc_id" in plan or "EqualTo(doc_id,3)" in plan


def test_no_rows(spark):
    path = new_work_dir(spark, "tokens") + "/orc"
    token_files.write(docs(spark, []), path, PATH, 2)
    assert token_files.digests(spark, path).count() == 0
