import pathlib

import pytest
from fixtures import docs

import corpus_pipeline
from matchlake.llm import mixing, near_dups, secrets_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="benchmark tables are not here")


def test_stages_one_after_another(spark):
    """Every stage against what its operator says of the stage's own input."""
    from matchlake.llm.common import table, written

    df, seen = table(spark, SF, "documents"), {}
    first = df.columns
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, df, SF), "t")
        seen[name] = (df, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first and dict(out.dtypes) == dict(df.dtypes)
        df = out
    ids = lambda x: sorted(r[0] for r in x.select("doc_id").collect())
    good = ids(seen["quality classifier"][1])
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    fine = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(fine & set(good)) >= 0.98 * len(fine) and len(bad & set(good)) <= 0.3 * len(bad) + 1
    before, after = seen["MinHash near-dedup"]
    assert ids(after) == sorted(r["doc_id"] for r in near_dups.near_duplicates(before, 80).where("kept").collect())
    before, after = seen["secret scans"]
    assert ids(before) == ids(after)
    assert not any(k in ("assign", "access") for r in after.select("text").collect() for _, _, k in secrets_scan.base_spans(r[0]))
    before, after = seen["mixing sources to target weights"]
    want = sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["taken"] // max(1, r["size"])))
    assert ids(after) == want
    before, after = seen["SentencePiece encoding and decoding"]
    assert ids(before) == ids(after) and all(r["exact"] for r in after.collect())


def test_stages_take_odd_rows(spark):
    for some in (docs(spark), docs(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, SF).count() <= 14 * 3


def test_near_duplicates_between_80_and_85_go(spark):
    """Two texts that share 83 of 100 shingles: one stays in the pipeline, both in the query's contract of 85."""
    words = [f"w{i}" for i in range(104)]
    other = words[:95] + [f"v{i}" for i in range(9)]
    some = docs(spark, [(1, " ".join(words), "en", "a", 1), (2, " ".join(other), "en", "a", 1)])
    a, b = ({tuple(w[i : i + 5]) for i in range(100)} for w in (words, other))
    assert 80 <= 100 * len(a & b) / len(a | b) < 85
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    assert [r["doc_id"] for r in stage(spark, some, SF).collect()] == [1]
    assert near_dups.near_duplicates(some, 85).where("kept").count() == 2
