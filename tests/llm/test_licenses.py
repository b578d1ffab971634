import math
import re
from collections import Counter

from fixtures import docs
from pyspark.sql import functions as F

from matchlake.llm import licenses


def plain_terms(text):
    return [w for w in re.split(r"[^a-z0-9.]+", re.sub(r"[.](?![0-9])", " ", text.lower())) if w]


def plain_match(notices):
    total = sum(notices.values())
    df = Counter()
    for n, times in notices.items():
        for t in set(plain_terms(n)):
            df[t] += times

    def vector(text):
        tf = Counter(plain_terms(text))
        v = {t: c * (math.log((1 + total) / (1 + df[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    out = {}
    for n in notices:
        v = vector(n)
        best = min((-round(sum(x * vector(t).get(w, 0) for w, x in v.items()), 9), name) for name, t in licenses.TEMPLATES)
        if -best[0] >= licenses.LEAST_COSINE:
            out[n] = (best[1], -best[0])
    return out


FILES = [
    ("proj/LICENSE", "Released under the MIT License."),
    ("proj/src/a.c", "int main() {}"),
    ("proj/src/deep/b.c", "Licensed under the Apache License, Version 2.0.\nint f() { return 1; } and very many other words of code that follow it here"),
    ("proj/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("proj/vendor/x/y.c", "no notice here"),
    ("other/z.c", "a licensed driver takes the bus to town every day of the week"),
    ("top.c", ""),
    (None, None),
]


def files(spark):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string")


def test_inheritance(spark):
    got = {r["doc_id"]: r for r in licenses.scan(files(spark)).collect()}
    assert len(got) == len(FILES)
    assert [got[i]["license"] for i in range(8)] == ["MIT", "MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0", None, None, None]
    assert (got[1]["inherited_from"], got[4]["inherited_from"], got[2]["inherited_from"]) == ("proj", "proj/vendor", None)
    assert got[0]["license_file"] and not got[2]["license_file"]


def test_cosines_equal_a_plain_version(spark):
    notices = {"Released under the MIT License.": 3, "Licensed under CC BY-NC 4.0.": 2, "You need a license to fish.": 1, "This is licensed under the GNU GPL version 3": 4}
    df = spark.createDataFrame(list(notices.items()), "notice string, times long")
    got = {r["notice"]: (r["license"], r["cosine"]) for r in licenses.matched(df, spark).collect()}
    want = plain_match(notices)
    assert got.keys() == want.keys()
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-6 for k, v in want.items())


def test_odd_rows(spark):
    df = docs(spark).withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    out = licenses.scan(df)
    assert out.count() == 14
    assert out.where("doc_id = 8").first()["own_license"] == "MIT"
    assert licenses.scan(docs(spark, [])).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_ancestors(spark):
    row = spark.createDataFrame([("a/b",), ("",)], "f string").select(licenses.ancestors(F.col("f")).alias("a")).collect()
    assert [(x["depth"], x["above"]) for x in row[0]["a"]] == [(0, ""), (1, "a"), (2, "a/b")]
    assert [(x["depth"], x["above"]) for x in row[1]["a"]] == [(0, "")]
