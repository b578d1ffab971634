import hashlib
import re

from fixtures import docs, rows, sentence
from pyspark.sql import functions as F

from matchlake.llm import fingerprints as fp


def plain_tree(text):
    d = lambda kind, s: hashlib.sha256((kind + s).encode()).hexdigest()[: fp.DIGITS]
    leaves = []
    for p in re.split(r"(?<=\n)", text):
        parts, at = [], 0
        for i in range(1, len(p) + 1):
            if i < len(p) + 1 and (re.search(r"[.!?|,;:&%#$*] $", p[:i]) or i - at == fp.LEAF_CHARS) and i > at:
                parts.append(p[at:i])
                at = i
        parts.append(p[at:])
        leaves.append([d("L", x) for x in parts])
    paragraphs = [d("P", "".join(x)) for x in leaves]
    joined = "".join(x + "/" if x[-1] in fp.SECTION_END else x for x in paragraphs)
    sections = [d("S", x) for x in joined.split("/")]
    return hashlib.sha256(("R" + "".join(sections)).encode()).hexdigest(), {x for y in leaves for x in y}


def likeness(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def expected(some):
    order = sorted(some, key=lambda r: r[0])
    out = {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, new, nxt = plain_tree(text), plain_tree(edited), plain_tree(after)
        out[r[0]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own[0], new[0], round(likeness(own[1], new[1]), 9), round(likeness(own[1], nxt[1]), 9))
    return out


def test_every_row_against_a_plain_tree(spark):
    some = [r for r in rows() if r[0] not in (None, 7)] + [(100 + i, sentence(i, 5 + i) + ".\n" + sentence(i % 3, 90) + ", x", None, None) for i in range(40)]
    some = [r[:4] for r in some]
    got = {r["doc_id"]: r for r in fp.compare_edited(docs(spark, some)).collect()}
    want = expected(some)
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"], round(g["near_edited"], 9), round(g["near_next"], 9)) == w, k


def test_odd_tables(spark):
    assert fp.compare_edited(docs(spark, [])).count() == 0
    one = fp.compare_edited(docs(spark, [(5, "abcd efgh", None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["near_next"] == 1.0
    all_ = fp.compare_edited(docs(spark)).collect()
    assert len(all_) == 14
    same = [r["fingerprint"] for r in all_ if r["doc_id"] in (1, 2)]
    assert same[0] == same[1]


def test_branches_locate_the_edit(spark):
    lines = [sentence(i, 12) + ".\n" for i in range(30)]
    changed = [*lines[:17], "another line.\n", *lines[18:]]
    df = spark.createDataFrame([("".join(lines), "".join(changed))], "a string, b string")
    df = fp.with_tree(fp.with_tree(df, "a", "x"), "b", "y")
    row = df.select(fp.differing(F.col("y_paragraphs"), F.col("x_paragraphs")).alias("p"), fp.differing(F.col("y_sections"), F.col("x_sections")).alias("s"), F.size("y_sections").alias("n")).first()
    assert row["p"] == [17] and 1 <= len(row["s"]) <= 2 < row["n"]


def test_plan_has_no_python(spark):
    plan = fp.compare_edited(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
