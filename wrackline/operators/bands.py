"""Band operators: percentile stretches, coverage, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.functions.constants import BAD, SCL_LEGEND

from .quantiles import selected

BANDS = ("b04", "b03", "b02")


def _stretched(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(v.isNotNull() & (hi > lo), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))).otherwise(0.0)


def _ends(values: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """keys, lo, hi: two exact percentiles of v in each group."""
    return selected(values, keys, "v", {"lo": low / 100, "hi": high / 100})


def stretch_bands(rgb: DataFrame, low: float = 2, high: float = 98) -> DataFrame:
    """Each band of each scene stretched between two percentiles of its values above 0, clipped to [0, 1].

    Without such values, or with equal ends, a band is 0; so is a missing value. Percentiles are exact: a histogram finds
    the bins that hold the wanted ranks, and only values in these are ranked.
    """
    long = rgb.select("scene_date", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in BANDS])).alias("p")).select("scene_date", "p.*")
    ends = _ends(long.where("v > 0"), ["scene_date", "band"], low, high)
    of = lambda c, b: F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{c}")
    rows = rgb.join(ends.groupBy("scene_date").agg(*[of(c, b) for b in BANDS for c in ("lo", "hi")]), "scene_date", "left")
    out = [F.coalesce(_stretched(F.col(b), F.col(f"{b}_lo"), F.col(f"{b}_hi")), F.lit(0.0)).alias(b) for b in BANDS]
    return rows.select("scene_date", "y", "x", *out)


def stretch_joint(rgb: DataFrame, low: float = 2, high: float = 98) -> DataFrame:
    """All bands stretched between two percentiles of the three taken together, over pixels that have every band (zeros count).

    Pixels that lack a band are black.
    """
    whole = F.lit(True)
    for b in BANDS:
        whole = whole & F.col(b).isNotNull()
    rows = rgb.withColumn("whole", whole)
    ends = _ends(rows.where("whole").select("scene_date", F.explode(F.array(*BANDS)).alias("v")), ["scene_date"], low, high)
    rows = rows.join(ends, "scene_date", "left")
    out = [F.when(F.col("whole"), F.coalesce(_stretched(F.col(b), F.col("lo"), F.col("hi")), F.lit(0.0))).otherwise(0.0).alias(b) for b in BANDS]
    return rows.select("scene_date", "y", "x", *out)


def clip_bands(stretched: DataFrame) -> DataFrame:
    """[0, 1] to whole numbers from 0 to 255, cut off, not rounded; missing is 0."""
    return stretched.select("scene_date", "y", "x", *[(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(b), F.lit(0.0)))) * 255).cast("int").alias(b) for b in BANDS])


def tile_coverage(rgb: DataFrame) -> DataFrame:
    """Percentage of each scene's pixels that have every band, to 2 decimals."""
    whole = F.col("b04").isNotNull() & F.col("b03").isNotNull() & F.col("b02").isNotNull()
    return rgb.groupBy("scene_date").agg(F.round(F.coalesce(F.try_divide(100.0 * F.count_if(whole), F.count("*")), F.lit(0.0)), 2).alias("coverage_pct"))


def coverage_filter(coverage: DataFrame, complete: float = 95, partial: float = 50) -> DataFrame:
    """The scenes' coverage kind: complete, partial or poor."""
    c = F.col("coverage_pct")
    return coverage.withColumn("kind", F.when(c >= complete, "complete").when(c >= partial, "partial").otherwise("poor"))


def legend(spark) -> DataFrame:
    return spark.createDataFrame(SCL_LEGEND, "scl int, label string, colour string, r int, g int, b int")


def classes_present(scl: DataFrame, bad: tuple = BAD) -> DataFrame:
    """The classes that occur, with label, colour and whether they are bad; unknown ones get a plain label and grey."""
    found = scl.select("scl").distinct().join(F.broadcast(legend(scl.sparkSession)), "scl", "left")
    label = F.coalesce("label", F.concat(F.lit("Clase "), F.col("scl").cast("string")))
    return found.select("scl", label.alias("label"), F.coalesce("colour", F.lit("#aaaaaa")).alias("colour"), F.col("scl").isin(*bad).alias("bad"))


def colourise(scl: DataFrame) -> DataFrame:
    """Red, green and blue of each pixel; a missing class is class 0, an unknown one black."""
    rows = scl.withColumn("scl", F.coalesce("scl", F.lit(0))).join(F.broadcast(legend(scl.sparkSession)), "scl", "left")
    return rows.select("scene_date", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "g", "b")])


def coverage_map_back(index: DataFrame, coverage: DataFrame) -> DataFrame:
    """index: scene_date and perhaps coverage_pct. A coverage that is there stays, others are looked up."""
    found = coverage.select("scene_date", F.col("coverage_pct").alias("found_pct"))
    own = F.col("coverage_pct") if "coverage_pct" in index.columns else F.lit(None).cast("double")
    return index.join(found, "scene_date", "left").withColumn("coverage_pct", F.coalesce(own, "found_pct")).drop("found_pct")
