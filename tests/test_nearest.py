"""Nearest nodes by descent through cells, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrackline.operators import nearest


def brute(targets, nodes, sizes):
    out = {}
    for name, lat, lon in targets:
        met = []
        for a, b in nodes:
            dy, dx = abs(a - lat), abs(b - lon)
            box = next((i for i, s in enumerate(sizes) if max(dy, dx) <= s), None)
            if box is not None:
                met.append((box, dy * dy + dx * dx, a, b))
        if met:
            out[name] = min(met)
    return out


@pytest.mark.parametrize(("seed", "sizes", "leaf", "step"), [(1, [1.0], 2, None), (2, [0.2, 0.5, 1.0], 3, None), (3, [0.5, 2.0], 1, 0.25), (4, [3.0], 64, None)])
def test_against_brute_force(spark, seed, sizes, leaf, step):
    r = np.random.default_rng(seed)
    nodes = np.concatenate([r.uniform(-4, 4, (60, 2)), r.normal(1.3, 0.01, (120, 2)), r.normal(-2.0, 1e-3, (60, 2))])
    places = np.concatenate([r.uniform(-5, 5, (80, 2)), nodes[60:75] + 1e-5, [[2.0, -2.0], [40.0, 40.0]]])
    if step:  # many ties, many repeated nodes
        nodes, places = np.round(nodes / step) * step, np.round(places / step) * step
    nodes = [tuple(map(float, n)) for n in nodes]
    targets = [(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(places)]
    t = spark.createDataFrame([*targets, ("nowhere", None, 1.0)], "target string, lat double, lon double")
    n = spark.createDataFrame([*nodes, (None, 0.0), (float("nan"), 0.0)], "lat double, lon double")
    got = {x.target: (x.box, x.d2, x.node_lat, x.node_lon) for x in nearest.nearest(t, n, sizes, leaf).collect()}
    assert got == brute(targets, nodes, sizes)


def test_without_nodes_or_targets(spark):
    t = spark.createDataFrame([("a", 0.0, 0.0)], "target string, lat double, lon double")
    n = spark.createDataFrame([(0.0, 0.1)], "lat double, lon double")
    assert nearest.nearest(t, n.limit(0), [1.0]).count() == 0
    assert nearest.nearest(t.limit(0), n, [1.0]).count() == 0


def test_rows_of_a_target_do_not_grow_with_density(spark):
    """A quarter million nodes in one box: each target is compared with few of them."""
    n = spark.range(250_000).select((F.rand(7) * 0.9).alias("lat"), (F.rand(8) * 0.9).alias("lon"))
    n = n.union(spark.range(20_000).select((0.5 + F.rand(9) * 1e-2).alias("lat"), (0.5 + F.rand(10) * 1e-2).alias("lon")))
    t = spark.range(200).select(F.concat(F.lit("t"), "id").alias("target"), (F.rand(3) * 0.9).alias("lat"), (F.rand(4) * 0.9).alias("lon"))
    levels, leaves = nearest._pyramid(n.select(F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon")), 1.0, nearest.LEAF)
    assert leaves.groupBy("level", "cy", "cx").count().agg(F.max("count")).first()[0] <= nearest.LEAF
    last = nearest._surviving(t, levels, [1.0])
    assert last.groupBy("target").count().agg(F.max("count")).first()[0] <= 16
    near = nearest.nearest(t, n, [1.0]).collect()
    assert len(near) == 200 and max(x.d2 for x in near) < 1e-3
