"""Licences of files: notices by sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A notice is a sentence or line that holds a cue word. Equal notices are compared once. The weights of words come from
all notices. A file whose notices make up half of its words, or that is named like one, is a licence file and speaks for
its directory: files without a notice of their own take the licence of the nearest directory at or above theirs.
Everything is column code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.common import WORD, utf8, written

#: Notices by which each licence is known.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: Words that make a sentence a notice, the ends of sentences, names of licence files.
CUE = r"(?i)\b(?:un)?licen[cs]e[ds]?\b|\bredistribute\b|\bpermission is hereby granted\b|\bpublic domain\b"
SENTENCE_END = r"\n|(?<=[.!?;]) +"
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: Least cosine of a notice to its template, least share of a licence file's words.
LEAST_COSINE = 0.6
FILE_SHARE = 0.5


def terms(text: Column) -> Column:
    """Words in lower case, version numbers whole."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[.](?![0-9])", " "), r"[^a-z0-9.]+"), lambda w: w != "")


def _weighted(rows: DataFrame, keys: list[str], idf: DataFrame, notices: int) -> DataFrame:
    """Term weights of each row, scaled to length 1. A word that no notice has weighs most."""
    counts = rows.select(*keys, F.explode(terms(F.col("notice"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    rare = F.log((1.0 + notices) / (1 + F.coalesce(F.col("df"), F.lit(0)))) + 1
    weights = counts.join(idf, "term", "left").withColumn("w", F.col("tf") * rare)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return weights.select(*keys, "term", (F.col("w") / length).alias("w"))


def matched(notices: DataFrame, spark: SparkSession) -> DataFrame:
    """notice, times -> notice, license, cosine of its nearest template, if near enough; ties to the first name."""
    seen = notices.select("notice", "times", F.explode(F.array_distinct(terms(F.col("notice")))).alias("term"))
    idf = seen.groupBy("term").agg(F.sum("times").alias("df"))
    total = notices.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    templates = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, license string, notice string")
    left = _weighted(notices, ["notice"], idf, total)
    right = _weighted(templates, ["template", "license"], idf, total).withColumnRenamed("w", "v")
    near = left.join(F.broadcast(right), "term").groupBy("notice", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    near = near.withColumn("cosine", F.round("cosine", 9)).where(F.col("cosine") >= LEAST_COSINE)
    best = near.groupBy("notice").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("b"))
    return best.select("notice", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the top as the empty path."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))


def scan(files: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """One row for each file: its own licence and cosine, whether it is a licence file, the licence that holds for it and from where.

    Without a path a file lies at the top. A null or empty text has no notice. Rows with the same path and text have the
    same result; files of one path count as one file with the notices of all.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key).alias(key), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), utf8(text).alias("text"))
    likely = rows.where(F.col("text").rlike(CUE))
    found = likely.select("path", F.xxhash64("text").alias("h"), F.regexp_count("text", F.lit(WORD)).alias("words"), F.explode(F.filter(F.split("text", SENTENCE_END), lambda s: s.rlike(CUE))).alias("notice"))
    found = written(found, "license-notices")  # the one pass over the texts; the notices are few
    notices = written(found.groupBy("notice").agg(F.count("*").alias("times")), "license-distinct")
    hits = found.join(matched(notices, spark), "notice").withColumn("own_words", F.regexp_count("notice", F.lit(WORD)))
    by_text = hits.groupBy("path", "h").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("b"), F.sum("own_words").alias("own"), F.max("words").alias("words"))
    own = by_text.groupBy("path").agg(F.min("b").alias("b"), F.max(F.col("own") >= FILE_SHARE * F.col("words")).alias("mostly"))
    own = own.select("path", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"), (F.col("mostly") | F.col("path").rlike(NAMED)).alias("license_file"))
    speaking = own.where("license_file").groupBy(directory(F.col("path")).alias("above"))
    speaking = speaking.agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("own_license").alias("license"))).alias("s"))
    folders = rows.select(directory(F.col("path")).alias("folder")).distinct()
    up = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.depth", "a.above")
    nearest = up.join(speaking, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", F.col("s.license").alias("license"))).alias("n"))
    out = rows.select(key, "path", directory(F.col("path")).alias("folder")).join(own, "path", "left").join(nearest, "folder", "left")
    inherited = F.col("own_license").isNull() & F.col("n").isNotNull()
    return out.select(
        key,
        "path",
        "own_license",
        "cosine",
        F.coalesce(F.col("license_file"), F.lit(False)).alias("license_file"),
        F.coalesce(F.col("own_license"), F.col("n.license")).alias("license"),
        F.when(inherited, F.col("n.above")).alias("inherited_from"),
    )
