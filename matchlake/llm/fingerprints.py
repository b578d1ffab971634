"""Document fingerprints: a Merkle tree from pieces of paragraphs over paragraphs and sections to a root.

Texts with equal roots are equal. Below different roots, the sections and paragraphs that differ tell where the edit is,
and the share of leaves that two trees have in common tells how alike the texts are. Everything is column code.

Leaves are pieces of a paragraph: they end after a mark and a space, and at the latest after LEAF_CHARS. A paragraph
ends with its line break. A section ends with a paragraph whose digest says so, one in eight, so that an insertion
moves no later boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import utf8

LEAF_CHARS = 256
#: A piece ends after one of these and a space, or when it is long.
PIECE_END = rf"(?s)(?<=[.!?|,;:&%#$*] )|(?<=\G.{{{LEAF_CHARS}}})"
PARAGRAPH_END = r"(?<=\n)"
#: Hex digits of the digests inside the tree; the root has all 64.
DIGITS = 32
#: Last hex digits of the paragraphs that end a section.
SECTION_END = ("0", "8")
#: Ranges of doc_id for each shuffle partition.
RANGES = 4


def _digest(kind: str, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(kind), content), 256), 1, DIGITS)


def leaves(text: Column) -> Column:
    """Digests of the pieces of each paragraph."""
    return F.transform(F.split(text, PARAGRAPH_END), lambda p: F.transform(F.split(p, PIECE_END), lambda s: _digest("L", s)))


def paragraphs(leaf_digests: Column) -> Column:
    return F.transform(leaf_digests, lambda x: _digest("P", F.array_join(x, "")))


def sections(paragraph_digests: Column) -> Column:
    marked = F.transform(paragraph_digests, lambda d: F.when(F.substring(d, DIGITS, 1).isin(*SECTION_END), F.concat(d, F.lit("/"))).otherwise(d))
    return F.transform(F.split(F.array_join(marked, ""), "/"), lambda s: _digest("S", s))


def root(section_digests: Column) -> Column:
    return F.sha2(F.concat(F.lit("R"), F.array_join(section_digests, "")), 256)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds root, section and paragraph digests and the distinct leaves' hashes as name_root, _sections, _paragraphs, _leaves."""
    df = df.withColumn(f"{name}_pieces", leaves(F.col(text)))
    df = df.withColumn(f"{name}_paragraphs", paragraphs(F.col(f"{name}_pieces")))
    df = df.withColumn(f"{name}_sections", sections(F.col(f"{name}_paragraphs")))
    df = df.withColumn(f"{name}_leaves", F.array_distinct(F.transform(F.flatten(F.col(f"{name}_pieces")), lambda d: F.xxhash64(d))))
    return df.withColumn(f"{name}_root", root(F.col(f"{name}_sections"))).drop(f"{name}_pieces")


def likeness(a: Column, b: Column) -> Column:
    """Twice the leaves in common by the leaves of both: 1 for the same leaves, 0 for none in common."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differing(a: Column, b: Column) -> Column:
    """Places, from 0, of the digests of a that b does not have: the branches that an edit touched."""
    at = F.transform(a, lambda d, i: F.when(~F.array_contains(b, d), i))
    return F.filter(at, lambda i: i.isNotNull())


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with its tree and the text and tree of the next row by doc_id, the first after the last.

    A null doc_id comes before all others; rows of one doc_id follow by a hash of their texts. Rows are dealt to ranges
    of doc_id, and the first of a range goes to the range before it as well, so that the texts are shuffled once.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    ids = docs.select(key.alias("k"))
    bounds = sorted(set(ids.agg(F.percentile_approx("k", shares, 100 * ranges)).first()[0] or []))
    in_range = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("k"))) if bounds else F.lit(0)
    # One number for each range comes to the driver.
    firsts = [(r["range"], r["first"]) for r in ids.groupBy(in_range.alias("range")).agg(F.min("k").alias("first")).orderBy("range").collect()]
    before = F.create_map(*[F.lit(x) for i, (_, k) in enumerate(firsts) for x in (k, firsts[i - 1][0])]) if firsts else F.create_map(F.lit(0), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("k"), utf8(text).alias("text")).withColumn("h", F.xxhash64("text"))
    twice = F.filter(F.array(F.struct(in_range.alias("range"), F.lit(0).alias("guest")), F.struct(F.try_element_at(before, F.col("k")).alias("range"), F.lit(1).alias("guest"))), lambda x: x["range"].isNotNull())
    rows = rows.select("*", F.explode(twice).alias("to")).select("doc_id", "k", "h", "text", "to.range", "to.guest")
    rows = with_tree(rows.repartition(F.col("range")), "text", "own")
    order = Window.partitionBy("range").orderBy("guest", "k", "h")
    rows = rows.withColumn("next", F.lead(F.struct("text", F.col("own_leaves").alias("leaves"))).over(order))
    return rows.where("guest = 0").drop("k", "h", "range", "guest")


def compare_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its last quarter replaced by the beginning of the next one's."""
    rows = with_next(docs, text).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) AS int))"), F.substring(F.col("next.text"), F.lit(1), quarter))
    rows = with_tree(rows.withColumn("edited", edited), "edited", "new")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("new_root").alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), F.col("new_leaves")).alias("near_edited"),
        likeness(F.col("own_leaves"), F.col("next.leaves")).alias("near_next"),
        F.size("own_sections").alias("n_sections"),
        F.size("own_paragraphs").alias("n_paragraphs"),
        F.element_at(F.concat(differing(F.col("new_paragraphs"), F.col("own_paragraphs")), F.array(F.lit(-1))), 1).alias("first_edited"),
    )
