"""Pixel votes, the two reference maps, and water frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.functions.constants import BAD, CLEAR, LAND, WATER
from wrackline.functions.expressions import share
from wrackline.sources.tiled import pixel_keys

from .quality import scene_quality
from .spatial import Steps, near_background


def pixel_votes(scl: DataFrame, water: int = WATER, land: tuple = LAND) -> DataFrame:
    """Votes of each pixel and their shares; shares are 0 where nobody voted."""
    votes = scl.groupBy(*pixel_keys(scl)).agg(F.count_if(F.col("scl") == water).alias("water_votes"), F.count_if(F.col("scl").isin(*land)).alias("land_votes")).drop("ty", "tx")
    n = F.greatest(F.col("water_votes") + F.col("land_votes"), F.lit(1))
    return votes.withColumns({"p_water": F.col("water_votes") / n, "p_land": F.col("land_votes") / n})


def reference_map_local(scl: DataFrame, stable: float = 0.98, buffer_pixels: int = 20) -> DataFrame:
    """Stable water, stable land and transition from all scenes, with a Euclidean coastal strip.

    A pixel is stable if it never was the other kind, so a pixel without a vote is stable land, and `stable` has an
    effect only outside (0, 1]. Stable pixels within buffer_pixels of both stable kinds join the transition; where a kind
    has no pixel, nothing is near it. p_land is 1 - p_water.
    """
    votes = pixel_votes(scl)
    is_water = (F.col("p_water") >= stable) & (F.col("land_votes") == 0)
    is_land = (F.col("p_water") <= 1 - stable) & (F.col("water_votes") == 0)
    kinds = votes.withColumn("kind", F.when(is_land, 2).when(is_water, 1).otherwise(0))
    near = lambda kind: near_background(kinds.select("y", "x", (F.col("kind") != kind).alias("inside")), buffer_pixels)
    coast = near(1).join(near(2), ["y", "x"]).withColumn("coast", F.lit(True))
    cls = F.when(F.coalesce("coast", F.lit(False)), 0).otherwise(F.col("kind"))
    return kinds.join(coast, ["y", "x"], "left").select("y", "x", cls.alias("cls"), "water_votes", "land_votes", "p_water", (1 - F.col("p_water")).alias("p_land"))


def reference_map_clean(scl: DataFrame, max_bad: float = 0.05, stable: float = 0.95, buffer_pixels: int = 5, bad: tuple = BAD) -> DataFrame:
    """The map from clean scenes only: shares of votes, transition dilated by 4-neighbour steps.

    A pixel without a vote is transition. Without a clean scene every pixel is. The frame is every pixel in scl.
    """
    clean = scene_quality(scl, bad).select("scene_date", (F.col("bad_fraction") <= max_bad).alias("clean"))
    seen = scl.join(clean, "scene_date", "left").withColumn("scl", F.when(F.col("clean"), F.col("scl")))
    rows = pixel_votes(seen).withColumn("kind", F.when(F.col("p_land") >= stable, 2).when(F.col("p_water") >= stable, 1).otherwise(0))
    wide = near_background(rows.select("y", "x", (F.col("kind") != 0).alias("inside")), buffer_pixels, Steps).withColumn("wide", F.lit(True))
    return rows.join(wide, ["y", "x"], "left").select("y", "x", F.when(F.col("wide"), 0).otherwise(F.col("kind")).alias("cls"), "water_votes", "land_votes", "p_water", "p_land")


def class_counts(reference_map: DataFrame) -> DataFrame:
    return reference_map.groupBy("cls").agg(F.count("*").alias("n"))


def date_semi_filter(scl: DataFrame, dates: DataFrame, on_empty: str = "all") -> DataFrame:
    """Rows of the given dates. If none match: all rows ('all'), or an error when the rows are read ('error')."""
    marked = scl.join(dates.select("scene_date", F.lit(True).alias("wanted")).distinct(), "scene_date", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    some = F.coalesce(scl.select("scene_date").distinct().join(dates.select("scene_date"), "scene_date", "left_semi").agg(F.count("*") > 0).scalar(), F.lit(False))
    if on_empty == "error":
        none = F.when(~some, F.raise_error(F.lit("no scene has one of the dates")).cast("boolean"))
        return marked.where(F.coalesce(none, F.col("wanted"))).select(scl.columns)
    return marked.where(F.col("wanted") | ~some).select(scl.columns)


def water_frequency(scl: DataFrame, min_obs: int = 8, water: int = WATER, clear: tuple = CLEAR) -> DataFrame:
    """Share of clear views that show water; NULL below min_obs (1 at least) clear views."""
    votes = scl.groupBy(*pixel_keys(scl)).agg(F.count_if(F.col("scl") == water).alias("water_votes"), F.count_if(F.col("scl").isin(*clear)).alias("clear_votes"))
    freq = F.when(F.col("clear_votes") >= max(1, min_obs), share(F.col("water_votes"), F.col("clear_votes")))
    return votes.select("y", "x", "clear_votes", freq.alias("water_freq"))


def intertidal_mask(freq: DataFrame, low: float = 0.10, high: float = 0.95) -> DataFrame:
    return freq.select("y", "x", F.coalesce(F.col("water_freq").between(low, high), F.lit(False)).alias("intertidal"))


def daily_composite(takes: DataFrame, value: str, method: str = "mean") -> DataFrame:
    """Several takes of a date in one: their mean, or for classes their mode (least of equals)."""
    how = F.avg(value) if method == "mean" else F.mode(value, deterministic=True)
    return takes.groupBy("scene_date", "y", "x").agg(how.alias(value))
