"""Scenes and maps by pixel tile: same rows as the join on pixels, and scenes are not moved."""

import pytest
from pyspark.sql import functions as F

from wrackline.operators import quality, refmap
from wrackline.sources import tiled


@pytest.fixture(scope="module")
def scenes(spark):
    """Three scenes with places below 0 and gaps; a map that covers part of them, with a class missing here and there."""
    grid = spark.range(40 * 30).select((F.col("id") % 40 - 17).cast("int").alias("y"), (F.floor(F.col("id") / 40) - 9).cast("int").alias("x"))
    rows = grid.crossJoin(spark.range(3).select(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("scene_date")))
    rows = rows.withColumn("h", F.pmod(F.hash("y", "x", "scene_date"), F.lit(97))).where("h > 4")
    scl = rows.select("scene_date", "y", "x", (F.col("h") % 12).alias("scl"))
    kinds = F.when(F.pmod(F.col("y"), F.lit(11)) == 0, F.lit(None)).otherwise(F.pmod(F.col("x") + F.col("y"), F.lit(3)))
    return scl, grid.where("y < 15 AND x > -6").withColumn("cls", kinds.cast("int"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("buckets", [None, 1, 13])
def test_same_rows_as_by_pixel(spark, scenes, buckets):
    scl, cls = scenes
    stored = tiled.store_tiled(scl, buckets)
    columns = ["scene_date", "y", "x", "scl", "cls"]
    assert rows_of(quality.with_map(stored, cls).select(columns)) == rows_of(scl.join(cls, ["y", "x"]).select(columns))
    for run in (quality.transition_quality, quality.transition_pct, quality.scene_cloud_score, quality.correct_scl):
        assert rows_of(run(stored, cls)) == rows_of(run(scl, cls)), run.__name__
    assert rows_of(refmap.pixel_votes(stored)) == rows_of(refmap.pixel_votes(scl))
    assert rows_of(refmap.water_frequency(stored, 1)) == rows_of(refmap.water_frequency(scl, 1))
    assert rows_of(refmap.reference_map_clean(stored, 0.9)) == rows_of(refmap.reference_map_clean(scl, 0.9))


def test_scenes_are_not_moved(spark, scenes):
    scl, cls = scenes
    stored = tiled.store_tiled(scl, 8)
    plan = quality.with_map(stored, cls)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("ShuffledHashJoin") :].split("HashAggregate")[0]
    assert "Bucketed: true" in side and "Exchange" not in side.split("FileScan")[0]
    votes = refmap.pixel_votes(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in votes


def test_nothing_is_left_in_the_catalog(spark, scenes):
    tiled.store_tiled(scenes[0], 4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tiled_")]


def test_empty(spark, scenes):
    scl, cls = scenes
    assert quality.with_map(tiled.store_tiled(scl.limit(0)), cls).count() == 0
    assert quality.with_map(tiled.store_tiled(scl), cls.limit(0)).count() == 0
