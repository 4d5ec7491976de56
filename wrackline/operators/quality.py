"""Scene quality: bad fractions over whole scenes and over the transition zone, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.functions.constants import BAD, TRANSITION, UNCERTAIN, WATER
from wrackline.functions.expressions import share
from wrackline.sources.tiled import meet_map


def scene_validity(scenes: DataFrame, value: str, strict_nan: bool = True) -> DataFrame:
    """valid: some value is above 0. With strict_nan a scene that has a missing value is invalid."""
    some = F.coalesce(F.max(F.col(value) > 0), F.lit(False))
    gap = F.coalesce(F.max(F.col(value).isNull()), F.lit(False))
    return scenes.groupBy("scene_date").agg((some & ~gap if strict_nan else some).alias("valid"))


def scene_quality(scl: DataFrame, bad: tuple = BAD, grid_pixels: int | None = None) -> DataFrame:
    """Bad fraction and class histogram of each scene. The denominator is the rows present, or grid_pixels."""
    counts = scl.groupBy("scene_date", "scl").agg(F.count("*").alias("n"))
    total = F.sum("n") if grid_pixels is None else F.lit(grid_pixels).cast("bigint")
    out = counts.groupBy("scene_date").agg(
        total.alias("total_pixels"),
        F.sum(F.when(F.col("scl").isin(*bad), F.col("n")).otherwise(0)).alias("bad_pixels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("scl", "n")))).alias("class_counts"),
    )
    fraction = share(F.col("bad_pixels"), F.col("total_pixels"))
    return out.withColumns({"bad_fraction": fraction, "bad_pct": fraction * 100})


def filter_by_quality(scl: DataFrame, max_bad: float = 0.20, bad: tuple = BAD) -> DataFrame:
    q = scene_quality(scl, bad)
    return q.select("scene_date", "bad_fraction", F.when(F.col("bad_fraction") <= max_bad, "valid").otherwise("discarded").alias("status"))


def with_map(scl: DataFrame, reference_map: DataFrame) -> DataFrame:
    """Scene pixels with the map's class, cropped to their common pixels. Scenes of store_tiled stay in their buckets; see meet_map."""
    return meet_map(scl, reference_map)


def transition_quality(scl: DataFrame, reference_map: DataFrame, bad: tuple = BAD) -> DataFrame:
    """Bad fraction within the transition zone; a scene without any such pixel counts as wholly bad."""
    inside = F.coalesce(F.col("cls") == TRANSITION, F.lit(False))
    rows = meet_map(scl, reference_map, "left")
    out = rows.groupBy("scene_date").agg(F.count_if(inside).alias("n_transition"), F.count_if(inside & F.col("scl").isin(*bad)).alias("n_bad"))
    fraction = share(F.col("n_bad"), F.col("n_transition"), 1.0)
    return out.withColumns({"bad_fraction": fraction, "bad_pct": fraction * 100})


def transition_pct(scl: DataFrame, reference_map: DataFrame, bad: tuple = BAD) -> DataFrame:
    """The same as a percentage with a denominator of 1 at least, so that an empty zone counts as clear."""
    q = transition_quality(scl, reference_map, bad)
    return q.select("scene_date", (F.col("n_bad") / F.greatest("n_transition", F.lit(1)) * 100).alias("transition_pct"))


def scene_cloud_score(scl: DataFrame, reference_map: DataFrame, threshold: float = 0.05, bad: tuple = BAD, exclude: DataFrame | None = None) -> DataFrame:
    """Global percentage where that is within the threshold, else the transition percentage, to 4 decimals.

    exclude: scene dates to leave out, such as those the map was built from.
    """
    rows = scl if exclude is None else scl.join(exclude.select("scene_date"), "scene_date", "left_anti")
    rows = meet_map(rows, reference_map, "left")
    inside, is_bad = F.coalesce(F.col("cls") == TRANSITION, F.lit(False)), F.col("scl").isin(*bad)
    sums = rows.groupBy("scene_date").agg(F.count("*").alias("n"), F.count_if(is_bad).alias("n_bad"), F.count_if(inside).alias("t"), F.count_if(inside & is_bad).alias("t_bad"))
    whole = F.col("n_bad") / F.col("n")
    zone = F.col("t_bad") / F.greatest("t", F.lit(1))
    return sums.select("scene_date", F.round(whole * 100, 4).alias("global_pct"), F.round(F.when(whole <= threshold, whole).otherwise(zone) * 100, 4).alias("cloud_pct"))


def classify_dates(scores: DataFrame, max_bad: float = 0.10, reference_bad: float = 0.05) -> DataFrame:
    """status of each scored date: reference, recovered or discarded."""
    f = F.col("cloud_pct") / 100
    return scores.select("scene_date", "cloud_pct", F.when(f <= reference_bad, "reference").when(f <= max_bad, "recovered").otherwise("discarded").alias("status"))


def recovery_gain(classified: DataFrame) -> DataFrame:
    """How many dates the transition filter adds. Zero denominators give 0."""
    sums = classified.agg(F.count_if(F.col("status") == "reference").alias("n_initial_valid"), F.count_if(F.col("status") == "recovered").alias("n_recovered"), F.count("*").alias("n_total_dates"))
    final = F.col("n_initial_valid") + F.col("n_recovered")
    return sums.select(
        "n_initial_valid",
        "n_recovered",
        final.alias("n_final_valid"),
        "n_total_dates",
        (share(F.col("n_initial_valid"), F.col("n_total_dates"), 0.0) * 100).alias("pct_initial"),
        (share(final, F.col("n_total_dates"), 0.0) * 100).alias("pct_final"),
        (share(F.col("n_recovered"), F.col("n_initial_valid"), 0.0) * 100).alias("gain_relative_pct"),
        F.col("n_recovered").alias("gain_absolute"),
    )


def correct_scl(scl: DataFrame, reference_map: DataFrame, uncertain: tuple = UNCERTAIN) -> DataFrame:
    """Uncertain classes become water or land where the map is stable; the transition zone is left alone."""
    doubtful = F.col("scl").isin(*uncertain)
    fixed = F.when(doubtful & (F.col("cls") == 1), WATER).when(doubtful & (F.col("cls") == 2), 5).otherwise(F.col("scl"))
    return with_map(scl, reference_map).select("scene_date", "y", "x", "scl", fixed.alias("scl_corrected"))


def dates_without(dates: DataFrame, reference: DataFrame) -> DataFrame:
    return dates.select("scene_date").distinct().join(reference.select("scene_date"), "scene_date", "left_anti")
