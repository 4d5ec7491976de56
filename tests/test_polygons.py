"""Polygons and parts at sizes where rows, rings and parts no longer fit into one task's share."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrackline.operators import places, spatial


def star(n, cx, cy, r, seed):
    """A ring of n vertices around a centre, with a random radius each."""
    g = np.random.default_rng(seed)
    return [(i, cx + r * g.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), cy + r * g.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def is_in(x, y, ring):
    inside = False
    for (_, x1, y1), (_, x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def ring_df(spark, ring):
    return spark.createDataFrame(ring, "vertex_no int, vx double, vy double").repartition(3)


def test_places(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7 % 1000).alias("a"), (F.col("id") % 3).alias("b")).unionByName(spark.createDataFrame([(None, 1), (5, 2), (5, 2)], "a bigint, b bigint"))
    got = [(r.place, r.a) for r in places.numbered(df, "a", "b").collect()]
    assert [p for p, _ in sorted(got)] == list(range(1003)) and [a for _, a in sorted(got)] == sorted((a for _, a in got), key=lambda a: -1 if a is None else a)
    assert places.numbered(df.where("a < 0"), "a").count() == 0


@pytest.mark.parametrize("band", [3, 1024])
def test_mask_of_ragged_rings(spark, monkeypatch, band):
    """Many edges a row, stretches with and without edges, pixels beyond the ring on all sides."""
    monkeypatch.setattr(spatial, "BAND", band)
    for ring in (star(60, 20, 15, 18, 1), [(0, -2.5, -3.0), (4, 40.0, -3.0), (7, 40.0, 33.5), (9, -2.5, 33.5)], [(0, 4.0, 4.0), (1, 60.0, 6.0), (2, 52.0, 44.0), (3, 8.0, 40.0)]):
        pixels = spark.createDataFrame([(y, x) for y in range(-3, 40) for x in range(-5, 50)], "y int, x int")
        got = spatial.aoi_mask(pixels, ring_df(spark, ring)).collect()
        assert len(got) == 43 * 55 and all(r.in_aoi == is_in(r.x + 0.5, r.y + 0.5, ring) for r in got)


@pytest.mark.parametrize("band", [2, 1024])
def test_grid_is_the_same_in_any_stretches(spark, monkeypatch, band):
    ring = star(25, 3, -8, 10, 4)
    monkeypatch.setattr(spatial, "BAND", band)
    got = {(r.i, r.j): (r.x0, r.y0, r.x1, r.y1) for r in spatial.make_grid(ring_df(spark, ring), 1.5).collect()}
    west, south = min(v[1] for v in ring), min(v[2] for v in ring)
    for i in range(math.ceil((max(v[1] for v in ring) - west) / 1.5)):
        for j in range(math.ceil((max(v[2] for v in ring) - south) / 1.5)):
            x0, y0 = west + i * 1.5, south + j * 1.5
            x1, y1 = x0 + 1.5, y0 + 1.5
            touches = any(is_in(x, y, ring) for x in (x0, x1) for y in (y0, y1)) or any(x0 <= x <= x1 and y0 <= y <= y1 for _, x, y in ring)
            for (_, ax, ay), (_, bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
                touches |= min(side) <= 0 <= max(side) and min(ax, bx) <= x1 and max(ax, bx) >= x0 and min(ay, by) <= y1 and max(ay, by) >= y0
            assert touches == ((i, j) in got), (i, j)


def test_a_million_vertices(spark):
    """A ring of a million vertices: edges meet by number, and no row holds the ring."""
    n = 1_000_000
    angle = 2 * math.pi * F.col("id") / n
    ring = spark.range(n, numPartitions=8).select(F.col("id").alias("vertex_no"), (1000 + 900 * F.cos(angle)).alias("vx"), (500 + 400 * F.sin(angle)).alias("vy"))
    c = spatial.polygon_centroid(ring).first()
    assert abs(c.cx - 1000) < 1e-6 and abs(c.cy - 500) < 1e-6
    pixels = spark.range(2000 * 50, numPartitions=4).select((F.col("id") / 2000).cast("int").alias("k"), (F.col("id") % 2000).cast("int").alias("x")).select((F.col("k") * 20).alias("y"), "x")
    d = ((F.col("x") + 0.5 - 1000) / 900) ** 2 + ((F.col("y") + 0.5 - 500) / 400) ** 2
    wrong = spatial.aoi_mask(pixels, ring).where((F.abs(d - 1) > 1e-6) & (F.col("in_aoi") != (d < 1)))
    assert wrong.count() == 0


def flood(cells):
    left, part, sizes = set(cells), {}, {}
    for start in sorted(cells):
        if start in left:
            left.discard(start)
            todo, name = [start], start
            part[start], sizes[name] = name, 0
            while todo:
                y, x = todo.pop()
                sizes[name] += 1
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if p in left:
                        left.discard(p)
                        part[p] = name
                        todo.append(p)
    return part, sizes


@pytest.mark.parametrize(("tile", "share", "dy", "dx"), [(1, 0.6, 0, 0), (5, 0.62, -7, 20), (512, 0.6, 0, 3)])
def test_parts_of_any_tiles(spark, tile, share, dy, dx):
    """Parts over many tiles, tiles of one pixel, negative rows; sizes come from the tiles."""
    g = np.random.default_rng(tile)
    cells = [(y + dy, x + dx) for y in range(26) for x in range(31) if g.random() < share]
    part, sizes = flood(cells)
    found = spatial.connected_components(spark.createDataFrame(cells, "y int, x int").repartition(3), 100, tile)
    got = {(r.y, r.x): (r.component, r.size) for r in found.collect()}
    assert got == {p: (part[p][0] * 100 + part[p][1], sizes[part[p]]) for p in cells}


def test_pixels_never_meet_by_part(spark):
    """The last plan's only exchanges of pixels are by tile and label; what is known of a part meets its labels in shares."""
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spatial.connected_components(cells, 20, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by = {x.split("(", 1)[1].split("), ")[0] for x in plan.split("\n") if "hashpartitioning" in x for x in [x[x.index("hashpartitioning") :]]}
    by = {",".join(p.split("#")[0].strip() for p in x.split(",") if "#" in p) for x in by}
    assert "ty,tx,label" in by and "component,salt" in by
