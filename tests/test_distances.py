"""Distances in tiles against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrackline.operators import spatial


def random_mask(seed, height, width, share, dy=0, dx=0, gaps=0.1):
    r = np.random.default_rng(seed)
    out = []
    for y in range(height):
        for x in range(width):
            if r.random() > gaps:
                out.append((y + dy, x + dx, bool(r.random() > share), bool(r.random() > 0.2)))
    return out


def brute(rows, size):
    back = np.array([(y, x) for y, x, inside, _ in rows if not inside])
    out = {}
    for y, x, _, want in rows:
        if want:
            out[y, x] = int(size(np.abs(back[:, 0] - y), np.abs(back[:, 1] - x)).min()) if len(back) else None
    return out


@pytest.mark.parametrize("metric", [spatial.Squares, spatial.Steps])
@pytest.mark.parametrize(("height", "width", "share", "strip", "tile", "dy", "dx"), [(23, 61, 0.02, 4, 7, 0, 0), (9, 120, 0.004, 3, 5, -4, -50), (40, 30, 0.3, 64, 4096, 10, 3), (30, 33, 0.01, 1, 1, 0, -7), (12, 12, 0.0, 4, 4, 0, 0)])
def test_tiles_pass_on_what_is_nearest(spark, metric, height, width, share, strip, tile, dy, dx):
    """Narrow tiles, tiles without background, negative places, absent pixels, no background at all."""
    rows = random_mask(height * width, height, width, share, dy, dx)
    mask = spark.createDataFrame(rows, "y int, x int, inside boolean, want boolean").repartition(3)
    got = spatial._distances(mask, metric, None, strip, tile).collect()
    assert len(got) == len({(r.y, r.x) for r in got}) and {(r.y, r.x): r.d for r in got} == brute(rows, metric.size)


@pytest.mark.parametrize(("metric", "reach"), [(spatial.Squares, 3), (spatial.Steps, 9), (spatial.Squares, 40)])
def test_reach(spark, metric, reach):
    rows = [(y, x, i, True) for y, x, i, _ in random_mask(7, 30, 50, 0.006)]
    mask = spark.createDataFrame(rows, "y int, x int, inside boolean, want boolean")
    far = {p: d for p, d in brute(rows, metric.size).items() if d <= metric.size(reach, 0)}
    found = spatial._distances(mask, metric, reach, 4, 6).where(F.col("d") <= metric.size(reach, 0))
    assert {(r.y, r.x): r.d for r in found.collect()} == far
    assert {tuple(r) for r in spatial.near_background(mask, reach, metric).collect()} == far.keys()


def test_a_million_columns(spark):
    """Four rows a million wide, background far apart: tasks see a tile, and long ways are exact."""
    width, at = 1_000_000, [(0, 0), (3, 250_000), (1, 250_001), (2, 999_999)]
    mask = spark.range(4 * width, numPartitions=8).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    back = F.lit(False)
    for y, x in at:
        back = back | ((F.col("y") == y) & (F.col("x") == x))
    mask = mask.withColumn("inside", ~back)
    near = F.least(*[(F.col("y").cast("bigint") - y) * (F.col("y") - y) + (F.col("x").cast("bigint") - x) * (F.col("x") - x) for y, x in at])
    far = spatial.distance_transform(mask)
    wrong, n, most = far.agg(F.count_if(F.col("d2") != near), F.count("d2"), F.max("d2")).first()
    assert (wrong, n) == (0, 4 * width) and most > 300_000**2
