"""Scenes and maps by pixel tile: scenes in buckets of tiles, maps with one row a tile, so that scenes meet maps where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import scratch

#: Side of a tile, rows of a bucket that a table of scenes aims at, and the most buckets that Spark takes by default.
TILE, BUCKET_ROWS, MOST_BUCKETS = 8, 20_000_000, 100_000
#: Class code of a pixel that the map has without a class.
UNKNOWN = -1


def tile(c: str) -> Column:
    return F.floor(F.col(c) / TILE).cast("int")


def _place() -> Column:
    return (F.pmod(F.col("y"), F.lit(TILE)) * TILE + F.pmod(F.col("x"), F.lit(TILE))).cast("int")


def with_tiles(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"ty": tile("y"), "tx": tile("x")})


def store_tiled(scenes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Writes scenes once, in buckets of tiles, and reads them back with ty and tx; jobs that group or join by tile don't move them.

    Tiles are cut in both directions, so a bucket holds many tiles from all over the scenes and none is hot. Files lie in the
    shared folder; the name that the bucketing needs for a moment leaves the catalog again, the files stay. Within a bucket
    rows go by date, so that a filter on dates skips row groups. By default the number of buckets follows from the number
    of rows; with fewer than spark.sql.shuffle.partitions Spark may prefer to shuffle the buckets again.
    """
    spark, name = scenes.sparkSession, f"tiled_{uuid.uuid4().hex}"
    rows = with_tiles(scenes)
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-scenes.count() // BUCKET_ROWS)))
    rows = rows.repartition(buckets, "ty", "tx").sortWithinPartitions("scene_date", "ty", "tx")
    rows.write.bucketBy(buckets, "ty", "tx").option("path", scratch(spark, "tiled")).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return out


def pixel_keys(pixels: DataFrame) -> list[str]:
    """What tells pixels apart: with their tile where they have one, so that grouping leaves buckets in place."""
    return ["ty", "tx", "y", "x"] if {"ty", "tx"} <= set(pixels.columns) else ["y", "x"]


def pack_map(reference_map: DataFrame) -> DataFrame:
    """(ty, tx, classes): one row a tile, with the class of each of its pixels; null where the map has no pixel.

    A map has each pixel once; of repeated ones the greatest class counts.
    """
    code, at = F.coalesce(F.col("cls").cast("int"), F.lit(UNKNOWN)), F.col("at")
    pixels = with_tiles(reference_map.select("y", "x", "cls")).select("ty", "tx", _place().alias("at"), code.alias("code"))
    return pixels.groupBy("ty", "tx").agg(F.array(*[F.max(F.when(at == i, F.col("code"))) for i in range(TILE * TILE)]).alias("classes"))


def meet_map(scenes: DataFrame, reference_map: DataFrame, how: str = "inner") -> DataFrame:
    """Scene pixels with the map's cls. inner: pixels that the map has; left: all, cls null where it hasn't.

    Scenes with tiles meet the packed map by tile: the map is moved to their buckets, one row for TILE * TILE pixels, and
    the scenes stay where they are. Other scenes join it on (y, x) as Spark sees fit.
    """
    if "ty" not in pixel_keys(scenes):
        return scenes.join(reference_map.select("y", "x", "cls"), ["y", "x"], how)
    rows = scenes.join(pack_map(reference_map).hint("shuffle_hash"), ["ty", "tx"], how).withColumn("_code", F.col("classes")[_place()])
    rows = rows if how == "left" else rows.where("_code IS NOT NULL")
    return rows.withColumn("cls", F.nullif("_code", F.lit(UNKNOWN)).cast(reference_map.schema["cls"].dataType)).drop("classes", "_code", "ty", "tx")
