"""Mixing sources to target weights by nested histograms of a hash.

Each source has a target number of words. Whole rounds over a source fill most of it; the rest is the documents whose
hash lies below a threshold of the source. The threshold is found without a sort: words are summed by source and by the
leading digits of the hash, the running sum names the one bucket that crosses the budget, and only that bucket is
summed again by the next digits, until a bucket is one hash value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import WORD, fresh_name, utf8, written

#: Weights of the sources in their order, from the first again after the last.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST_ROUNDS = 3
#: Bits of the hash for each level of the histogram; the last level ends at single hash values.
LEVELS = (12, 16, 16, 16)
HASH_BITS = sum(LEVELS)


def n_words(text: Column) -> Column:
    """Runs of anything but the six separators. Each begins at a place that a separator, or the start, is before."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def document_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of key and text, as a whole number from 0; a null key counts as empty, a null text too."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\x01"), text)
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target: shares by weight of all sizes, none above MOST_ROUNDS times its source.

    What is above goes to the others by weight, again and again. That ends at one level L, where a target is the smaller
    of its limit and weight * L; sources fill up in the order of limit / weight. One row for each source comes here.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", MOST_ROUNDS * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(up_to), F.lit(0))
    free_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0))
    # The level if exactly the sources before this one were full; the first that it leaves room in sets it for the rest.
    rows = rows.withColumn("level", free / free_weight).withColumn("fits", F.col("weight") * F.col("level") <= F.col("most"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"]
    fill = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return rows.select("source", "source_size", fill.alias("target"))


def _bucket(hashed: Column, level: int) -> Column:
    """The hash cut after the digits of this level and all before it."""
    return F.shiftright(hashed, HASH_BITS - sum(LEVELS[: level + 1]))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, below: documents of the source with a smaller hash come nearest to its budget.

    Each level leaves one bucket of a source; what is read is the narrow table of sizes, written once.
    """
    open_ = budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level, bits in enumerate(LEVELS):
        cells = rows.select("source", "size", "hash", _bucket(F.col("hash"), level).alias("bucket"))
        same = (cells["source"].eqNullSafe(open_["source"])) & (F.shiftright(cells["bucket"], bits) == open_["prefix"])
        sums = cells.join(open_, same).groupBy(open_["source"], "budget", "bucket").agg(F.sum("size").alias("words"))
        # At most 2**bits rows of a source meet here.
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        crossing = sums.where("before < budget AND before + words >= budget")
        crossing = written(crossing.select("source", "budget", "bucket", "before", "words"), "mix-level")
        # A source whose words all fit, rounding aside, has no crossing: everything is below.
        lost = open_.join(crossing.select(F.col("source").alias("s")), F.col("s").eqNullSafe(F.col("source")), "left_anti")
        full = lost.select("source", F.when(F.col("budget") > 0, _end(F.col("prefix"), level)).otherwise(_start(F.col("prefix"), level)).alias("below"))
        done = full if done is None else done.unionByName(full)
        open_ = crossing.select("source", (F.col("budget") - F.col("before")).alias("budget"), F.col("bucket").alias("prefix"))
        last = crossing
    # The last bucket is one hash value: take it if that comes nearer.
    nearer = F.col("before") + F.col("words") - F.col("budget") < F.col("budget") - F.col("before")
    ends = last.select("source", (F.col("bucket") + nearer.cast("long")).alias("below"))
    return done.unionByName(ends)


def _start(prefix: Column, level: int) -> Column:
    return F.shiftleft(prefix, HASH_BITS - sum(LEVELS[:level]))


def _end(prefix: Column, level: int) -> Column:
    return F.shiftleft(prefix + 1, HASH_BITS - sum(LEVELS[:level]))


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The narrow rows (key, source, size, hash), and for each source its size, target, whole rounds and threshold."""
    hashed = document_hash(F.col(key), utf8(text)).alias("hash")
    narrow = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(utf8(text)).alias("size"), hashed)
    rows = written(narrow, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(targets(sizes), "mix-targets")
    rounds = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_ROUNDS))
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, rounds).otherwise(F.lit(0)).cast("long"))
    budgets = plan.select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"))
    limits = thresholds(rows, budgets).withColumnRenamed("source", "limit_source")
    plan = plan.join(limits, F.col("limit_source").eqNullSafe(F.col("source")), "left")
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "rounds", F.coalesce("below", F.lit(0).cast("long")).alias("below"))
    return rows, written(plan, "mix-plan")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The key of each row with size, source_size, target and taken, the words that the mixture takes of it.

    A document is taken whole, 0 to MOST_ROUNDS times. Rows that have both key and text in common are taken alike; rows that
    share the key alone, a null one too, are not. A null source is a source, the last one; a null text has size 0 and is taken
    0 words; no rows give no rows. A source's taken words differ from its target by at most half of the document, or of the
    equal rows, that stands at the threshold.
    """
    rows, plan = planned(docs, key, text, source)
    taken = F.col("size") * (F.col("rounds") + (F.col("hash") < F.col("below")).cast("long"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mixture takes them, with their own columns; those without words are not taken.

    Whether a document is below its source's threshold shows on its own row, so the texts are not shuffled.
    """
    plan = planned(docs, key, text, source)[1].select("plan_source", "rounds", "below")
    names = {c: fresh_name(docs, f"mix_{c}") for c in plan.columns}
    rows = docs.join(plan.withColumnsRenamed(names), F.col(f"`{source}`").cast("string").eqNullSafe(F.col(names["plan_source"])))
    times = F.col(names["rounds"]) + (document_hash(F.col(f"`{key}`"), utf8(text)) < F.col(names["below"])).cast("long")
    times = F.when(utf8(text).rlike(WORD), times).otherwise(F.lit(0))
    again = F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)))
    return rows.withColumn(fresh_name(rows, "mix_round"), again).select(*[F.col(f"`{c}`") for c in docs.columns])
