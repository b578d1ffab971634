"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("kept", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("h", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box and vex other old jolly knights near dark mills".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)])
    return " ".join(out)


def rows():
    base = sentence(1, 60)
    texts = [
        (1, base, "en", "b", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base + " end", "en", "b", len(base) + 4),
        (4, None, "en", "a", 0),
        (5, "", None, None, 0),
        (6, "one two", "en", None, 7),
        (7, "ONE\ttwo", "de", "a", 7),
        (7, "ONE\ttwo", "de", "a", 7),
        (8, sentence(2, 40) + "\n\n" + sentence(3, 30) + ".\nReleased under the MIT License.", "en", "c", None),
        (9, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "es", "c", 54),
        (10, "é\U0001F600▁  \x00 " + sentence(4, 20), "fr", "\U0001F600", 130),
        (11, sentence(5, 4000), "en", "a", None),
        (None, "no id at all", None, "b", 12),
        (12, "   \n\t ", "en", "b", 6),
    ]
    return [(*t, "k", "s", "h", None) for t in texts]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else [(*r, *[None] * (9 - len(r))) for r in some], DOCS)
