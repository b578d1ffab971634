"""Champion catalog: list, images, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from matchlake.functions.text import image_urls, normalise_name


def champion_list(catalog: DataFrame, version: str | None = None) -> DataFrame:
    """Catalog with images and normalised name, by name. Image links use `version` or the entry's own."""
    ver = F.lit(version) if version else F.col("version")
    return catalog.select(
        "championId",
        "id",
        "name",
        "title",
        normalise_name("name").alias("normalName"),
        image_urls("id", ver).alias("images"),
    )


def sorted_champions(catalog: DataFrame, version: str | None = None, locale: str = "pt") -> DataFrame:
    """The list with `place` in the order of the locale and `total`, the number of champions. A catalog is small."""
    order = Window.orderBy(F.collate("name", locale), "championId")
    rows = champion_list(catalog, version).withColumns({"place": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy())})
    return rows.orderBy("place")


def enrich(stats: DataFrame, catalog: DataFrame, version: str | None = None, keep_unknown: bool = True) -> DataFrame:
    """Champion name and square image. Unknown champions get a made-up name, or are dropped."""
    info = champion_list(catalog, version).select(
        "championId", F.col("name").alias("_name"), F.col("images.square").alias("_square")
    )
    joined = stats.join(info, "championId", "left" if keep_unknown else "inner")
    fallback = F.concat(F.lit("Champion "), F.col("championId").cast("string"))
    return joined.withColumns(
        {"championName": F.coalesce("_name", fallback), "imageUrl": F.coalesce("_square", F.lit(""))}
    ).drop("_name", "_square")
