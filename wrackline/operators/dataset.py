"""The dataset index: scenes with their overpass, tide, cloud and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def half_even(value, digits: int):
    """Round half to even, on the number's decimal digits."""
    return F.bround(value.cast("decimal(38,12)"), digits).cast("double")


def assemble(scenes: DataFrame, overpass: DataFrame, tide: DataFrame, cloud: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per scene date that has an overpass. overpass: scene_date, dt_utc. tide: dt_utc, height_m. cloud: scene_date, cloud_pct."""
    rows = scenes.select("scene_date").distinct().join(overpass, "scene_date").join(tide.select("dt_utc", "height_m"), "dt_utc", "left")
    return rows.join(cloud.select("scene_date", "cloud_pct"), "scene_date", "left").join(coverage.select("scene_date", "coverage_pct"), "scene_date", "left")


def index_columns(rows: DataFrame, lat: float, lon: float) -> DataFrame:
    """The columns of the index file."""
    d = F.date_format("scene_date", "yyyy-MM-dd")
    return rows.select(
        F.col("scene_date").alias("fecha"),
        F.date_format("dt_utc", "HH:mm:ss").alias("hora_utc"),
        F.date_format("dt_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime_utc"),
        F.concat(F.lit("rgb_png/rgb_"), d, F.lit(".png")).alias("imagen_rgb"),
        F.concat(F.lit("scl_png/scl_"), d, F.lit(".png")).alias("imagen_scl"),
        half_even(F.col("height_m"), 3).alias("marea_m"),
        half_even(F.col("cloud_pct"), 2).alias("nubes_pct"),
        F.col("coverage_pct").alias("cobertura_tile_pct"),
        F.lit(lat).alias("lat"),
        F.lit(lon).alias("lon"),
        F.concat(F.lit("rgb/rgb_"), d, F.lit(".tif")).alias("imagen_rgb_tif"),
        F.concat(F.lit("scl/scl_"), d, F.lit(".tif")).alias("imagen_scl_tif"),
    )


def dates_per_year(dates: DataFrame, first: int = 2015, last: int = 2024) -> DataFrame:
    """Dates in each year, zeros included."""
    years = dates.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counts = dates.groupBy(F.year("scene_date").alias("year")).agg(F.count("*").alias("n"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
