import numpy as np
import public_tokenizers
import pytest
from fixtures import docs, rows
from tokenizers import Tokenizer

from matchlake.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text, rule):
    """Every token's bytes against every section's."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    names = {i: len(k) for k, i in t.get_vocab().items()}
    lines = text.splitlines(keepends=True) if not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    owner = [n for n, line in enumerate(lines) for _ in line.encode()]
    counts, crossing, at = [0] * max(1, len(lines)), [0] * max(1, len(lines)), 0
    for i in t.encode(text, add_special_tokens=False).ids:
        mine = owner[at : at + names[i]]
        of = mine[0] if rule == "first" else max(sorted(set(mine)), key=mine.count)
        counts[of] += 1
        crossing[of] += len(set(mine)) > 1
        at += names[i]
    ends = np.cumsum([len(x) for x in lines]).tolist() or [0]
    return [(n, e - len(lines[n]) if lines else 0, e, counts[n], crossing[n]) for n, e in enumerate(ends)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_of_rows(spark, rule):
    some = [(100, "a\n\n\n\nb\n\n\n", None, None), (101, "\n", None, None), (102, "x\r\n\r\ny", None, None)]
    df = docs(spark).unionByName(docs(spark, some))
    got = {}
    for r in token_counts.count(df, PATH, rule).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for d, text, *_ in [*rows(), *some]:
        times = sum(x[0] == d for x in rows()) or 1
        assert sorted(got[d]) == sorted(plain(text or "", rule) * times), d


def test_most_goes_to_the_larger_part():
    tokens, sections = np.array([3, 8, 10]), np.array([4, 10])
    assert [x.tolist() for x in token_counts.attribute(tokens, sections, "first")] == [[2, 1], [1, 0]]
    assert [x.tolist() for x in token_counts.attribute(tokens, sections, "most")] == [[1, 2], [0, 1]]
    with pytest.raises(ValueError):
        token_counts.count(None, PATH, "last")
