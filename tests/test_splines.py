"""Splines solved in blocks against the dense system of the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrackline.operators import splines


def dense(x, y, at):
    """Cubic spline with not-a-knot ends; a parabola or a line for three or two points."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    a[0, :2] = h[1], h[0] + h[1]
    b[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[-1, -2:] = h[-1] + h[-2], h[-2]
    b[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    s = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u = at - x[k]
    c2, c3 = (3 * d[k] - 2 * s[k] - s[k + 1]) / h[k], (s[k] + s[k + 1] - 2 * d[k]) / h[k] ** 2
    return y[k] + u * (s[k] + u * (c2 + u * c3))


@pytest.fixture(scope="module")
def case(spark):
    r = np.random.default_rng(1)
    rows, wanted, true = [], [], {}
    for name, n in (("a", 203), ("b", 4), ("c", 3), ("d", 2), ("e", 1), ("f", 5), ("g", 9), ("h", 33)):
        x = np.cumsum(r.uniform(0.05, 3, n) * 10 ** r.uniform(-2, 1, n))
        y = np.sin(x) + r.normal(0, 0.3, n)
        t = np.concatenate([x, r.uniform(x[0] - 1, x[-1] + 1, 60)])
        rows += [(name, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(name, float(x[0]) + 0.01, None)]
        wanted += [(name, float(v)) for v in t]
        inside = np.unique(t[(t >= x[0]) & (t <= x[-1])])
        if n > 1:
            true.update({(name, float(v)): h for v, h in zip(inside, dense(x, y, inside), strict=True)})
    series = spark.createDataFrame(rows + rows[:40] + [(None, 1.0, 2.0), ("a", None, 1.0), ("a", 3.0, float("nan"))], "node string, t double, z double")
    times = spark.createDataFrame(wanted + wanted[:9] + [("none", 1.0), (None, 2.0), ("a", None)], "node string, t double")
    return times.repartition(3), series.withColumn("k", F.lit("clash")).repartition(3), true


@pytest.mark.parametrize(("block", "run"), [(8, 3), (4, 2), (5, 4), (4096, 1024)])
def test_equals_the_whole_system(case, block, run):
    """Runs of runs of blocks, blocks of one knot, irregular spacing, repeated knots and times."""
    times, series, true = case
    got = splines.spline(times, series, block, run).collect()
    assert len(got) == len(true) and {(r.node, r.t) for r in got} == true.keys()
    assert max(abs(r.height_m - true[r.node, r.t]) / max(1, abs(true[r.node, r.t])) for r in got) < 1e-9


def test_long_series(spark):
    """Minutes of more than a year, of which the dense system would take a terabyte; the second derivative at inner knots is continuous."""
    n = 400_000
    f = F.sin(F.col("t") / 37) + F.cos(F.col("t") * F.col("t") / 1e9)
    series = spark.range(n, numPartitions=4).select(F.lit("s").alias("node"), F.col("id").cast("double").alias("t")).withColumn("z", f)
    times = series.select("node", F.col("t") + 0.5)
    got = splines.spline(times.toDF("node", "t"), series, 1000, 7)
    worst, count = got.withColumn("e", F.abs(F.col("height_m") - f)).agg(F.max("e"), F.count("*")).first()
    assert count == n - 1 and worst < 1e-7


def test_no_series(case):
    times, series, _ = case
    assert splines.spline(times, series.where("t < -5")).count() == 0 and splines.spline(times.where("t < -5"), series).count() == 0
