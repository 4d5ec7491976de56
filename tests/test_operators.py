"""Hand-sized goldens and comparisons with numpy for the coastal operators."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wrackline.functions.expressions import dms_parts, histogram_bin, iso_date
from wrackline.operators import bands, dataset, metrics, quality, quantiles, refmap, spatial, tides
from wrackline.sources import readers

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def pixels(spark, scenes):
    """scenes: date to rows of classes (a blank is an absent pixel)."""
    rows = [(d, y, x, int(c, 16)) for d, lines in scenes.items() for y, line in enumerate(lines) for x, c in enumerate(line) if c != " "]
    return spark.createDataFrame(rows, "scene_date date, y int, x int, scl int")


def grid(df, value, height, width):
    out = np.full((height, width), None, object)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def mask_rows(spark, a):
    return spark.createDataFrame([(int(y), int(x), bool(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y int, x int, inside boolean")


def test_pixel_without_a_vote(spark):
    """The local map takes it for land, the clean map for transition."""
    scl = pixels(spark, {D1: ["6637"], D2: ["6657"]})
    assert grid(refmap.reference_map_local(scl, 0.98, 0), "cls", 1, 4).tolist() == [[1, 1, 2, 2]]
    assert grid(refmap.reference_map_clean(scl, 1.0, 0.95, 0), "cls", 1, 4).tolist() == [[1, 1, 2, 0]]


def test_coastal_strip_needs_both_kinds(spark):
    scl = pixels(spark, {D1: ["66666655555"]})
    assert grid(refmap.reference_map_local(scl, 0.98, 2), "cls", 1, 11).tolist() == [[1, 1, 1, 1, 0, 0, 0, 0, 2, 2, 2]]
    only = pixels(spark, {D1: ["666666"]})
    assert grid(refmap.reference_map_local(only, 0.98, 5), "cls", 1, 6).tolist() == [[1] * 6]


def test_clean_map_without_a_clean_scene(spark):
    m = refmap.reference_map_clean(pixels(spark, {D1: ["8865"]}), 0.05)
    assert {r.cls for r in m.collect()} == {0} and m.count() == 4


def test_quality_and_scores(spark):
    scl = pixels(spark, {D1: ["8665", "6655"], D2: ["8886", "8888"]})
    q = {r.scene_date: r for r in quality.scene_quality(scl).collect()}
    assert q[D1].bad_fraction == 1 / 8 and q[D1].class_counts == {5: 3, 6: 4, 8: 1}
    assert quality.scene_quality(scl, grid_pixels=16).where(F.col("scene_date") == D1).first().bad_fraction == 1 / 16
    m = spark.createDataFrame([(0, 3, 0), (0, 0, 1)], "y int, x int, cls int")
    t = {r.scene_date: r for r in quality.transition_quality(scl, m).collect()}
    assert (t[D1].n_transition, t[D1].bad_fraction) == (1, 0.0)
    none = m.where("cls = 1")
    assert quality.transition_quality(scl, none).first().bad_fraction == 1.0
    assert quality.transition_pct(scl, none).first().transition_pct == 0.0
    s = {r.scene_date: r.cloud_pct for r in quality.scene_cloud_score(scl, m).collect()}
    assert s == {D1: 0.0, D2: 0.0}
    assert {r.scene_date for r in quality.scene_cloud_score(scl, m, exclude=scl.where(F.col("scene_date") == D1)).collect()} == {D2}


def test_gain_without_dates(spark):
    empty = spark.createDataFrame([], "scene_date date, cloud_pct double, status string")
    assert tuple(quality.recovery_gain(empty).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0)


def test_validity_with_missing_values(spark):
    rows = spark.createDataFrame([(D1, 1.0), (D1, None), (D2, 0.0)], "scene_date date, v double")
    assert {r.scene_date: r.valid for r in quality.scene_validity(rows, "v").collect()} == {D1: False, D2: False}
    assert {r.scene_date: r.valid for r in quality.scene_validity(rows, "v", False).collect()} == {D1: True, D2: False}


def test_corrected_classes(spark):
    scl = pixels(spark, {D1: ["89b89"]})
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1), (0, 3, 0)], "y int, x int, cls int")
    assert grid(quality.correct_scl(scl, m), "scl_corrected", 1, 5).tolist() == [[6, 5, 11, 8, None]]


def test_date_filter_without_a_match(spark):
    scl = pixels(spark, {D1: ["66"]})
    other = spark.createDataFrame([(D2,)], "scene_date date")
    assert refmap.date_semi_filter(scl, other).count() == 2
    same = spark.createDataFrame([(D1,)], "scene_date date")
    assert refmap.date_semi_filter(scl, same).count() == refmap.date_semi_filter(scl, same, "error").count() == 2
    with pytest.raises(Exception, match="no scene has one of the dates"):
        refmap.date_semi_filter(scl, other, "error").collect()
    with pytest.raises(FileNotFoundError):
        readers.scan_stack(scl, ["2024-01-01", "2024-01-02"])


def test_frequency_needs_views(spark):
    scl = pixels(spark, {D1: ["68"], D2: ["58"]})
    assert grid(refmap.water_frequency(scl, 2), "water_freq", 1, 2).tolist() == [[0.5, None]]
    assert grid(refmap.water_frequency(scl, 0), "water_freq", 1, 2).tolist() == [[0.5, None]]
    assert grid(refmap.intertidal_mask(refmap.water_frequency(scl, 2)), "intertidal", 1, 2).tolist() == [[True, False]]


def test_spread_and_distance_against_numpy(spark):
    r = np.random.default_rng(3)
    a = r.random((17, 23)) < 0.12
    frame = mask_rows(spark, a)
    points = np.argwhere(a)
    yy, xx = np.indices(a.shape)
    d2 = ((yy[..., None] - points[:, 0]) ** 2 + (xx[..., None] - points[:, 1]) ** 2).min(axis=2)
    l1 = (abs(yy[..., None] - points[:, 0]) + abs(xx[..., None] - points[:, 1])).min(axis=2)
    some = frame.where("inside")
    for n in (0, 1, 3):
        got = {(p.y, p.x) for p in spatial.within_radius(frame, some, n).collect()}
        assert got == set(map(tuple, np.argwhere(d2 <= n * n)))
        got = {(p.y, p.x) for p in spatial.dilate(some, frame, n).collect()}
        assert got == set(map(tuple, np.argwhere(l1 <= n)))
    far = spatial.distance_transform(frame.withColumn("inside", ~F.col("inside")))
    assert (grid(far, "d2", 17, 23).astype(int) == d2).all()
    whole = spatial.distance_transform(mask_rows(spark, np.ones((2, 3), bool)))
    assert {p.d2 for p in whole.collect()} == {None}


def flood(a):
    label, sizes = -np.ones(a.shape, int), {}
    for y, x in np.argwhere(a):
        if label[y, x] < 0:
            todo, at = [(y, x)], y * a.shape[1] + x
            label[y, x], n = at, 0
            while todo:
                p, q = todo.pop()
                n += 1
                for s, t in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                    if 0 <= s < a.shape[0] and 0 <= t < a.shape[1] and a[s, t] and label[s, t] < 0:
                        label[s, t] = at
                        todo.append((s, t))
            sizes[at] = n
    return label, sizes


def test_components_against_flood_fill(spark):
    a = np.random.default_rng(8).random((14, 19)) < 0.55
    label, sizes = flood(a)
    got = spatial.connected_components(mask_rows(spark, a).where("inside"), 19, 5).collect()
    assert len(got) == a.sum()
    assert all(r.component == label[r.y, r.x] and r.size == sizes[r.component] for r in got)


def ring_areas(spark, a):
    rows = spatial.rings(mask_rows(spark, a).where("inside"), a.shape[1]).collect()
    rings = {}
    for r in sorted(rows, key=lambda r: (r.ring, r.pos)):
        rings.setdefault(r.ring, []).append((r.x, r.y))
    for p in rings.values():  # unit steps all the way round
        assert all(abs(x1 - x2) + abs(y1 - y2) == 1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True))
    return [sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True)) / 2 for p in rings.values()]


def test_rings_enclose_their_parts(spark):
    a = np.array([list(map(int, s)) for s in ("11100", "10101", "11100", "00011")], bool)
    assert sorted(ring_areas(spark, a)) == [-1, 1, 2, 9]
    b = np.random.default_rng(5).random((20, 30)) < 0.6
    areas, (_, sizes) = ring_areas(spark, b), flood(b)
    assert sum(areas) == b.sum() and sum(x > 0 for x in areas) == len(sizes)
    assert ring_areas(spark, np.zeros((2, 2), bool)) == []


def test_distances_on_a_large_sparse_mask(spark):
    """2,000 x 2,000, mostly absent: pixels that are absent are neither inside nor background."""
    r = np.random.default_rng(11)
    at = np.unique(r.integers(0, 2000, (9000, 2)), axis=0)
    inside = r.random(len(at)) < 0.97
    df = spark.createDataFrame(pd.DataFrame({"y": at[:, 0], "x": at[:, 1], "inside": inside})).selectExpr("int(y) y", "int(x) x", "inside")
    off = at[~inside]
    want = {tuple(p): int(((off - p) ** 2).sum(axis=1).min()) for p in at}
    assert {(p.y, p.x): p.d2 for p in spatial.distance_transform(df).collect()} == want
    near = {(p.y, p.x) for p in spatial.within_radius(df, df.where("not inside"), 90).collect()}
    assert near == {p for p, d in want.items() if d <= 8100}
    steps = {tuple(p) for p in at if abs(off - p).sum(axis=1).min() <= 90}
    assert {(p.y, p.x) for p in spatial.dilate(df.where("not inside"), df, 90).collect()} == steps


def test_polygon_without_a_limit(spark):
    """20,000 vertices on a circle against the radius, and cells against a plain test."""
    n = 20_000
    ring = [(i, 100 + 80 * math.cos(2 * math.pi * i / n), 100 + 80 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    v = spark.createDataFrame(ring, "vertex_no int, vx double, vy double")
    px = spark.createDataFrame([(y, x) for y in range(0, 200, 7) for x in range(0, 200, 5)], "y int, x int")
    assert all(r.in_aoi == (math.hypot(r.x + 0.5 - 100, r.y + 0.5 - 100) < 80) for r in spatial.aoi_mask(px, v).collect())
    got = {(c.i, c.j) for c in spatial.make_grid(v, 10.0).collect()}
    near = lambda k: max(20 + 10 * k - 100, 100 - (30 + 10 * k), 0)
    assert got == {(i, j) for i in range(16) for j in range(16) if math.hypot(near(i), near(j)) <= 80}


def test_polygons(spark):
    square = spark.createDataFrame([(0, 0, 0), (1, 4, 0), (2, 4, 2), (3, 0, 2)], "vertex_no int, vx int, vy int")
    assert tuple(spatial.polygon_centroid(square).first()) == (2.0, 1.0)
    assert tuple(spatial.extent_pad(square).first()) == (-0.2, 4.2, -0.1, 2.1)
    assert spatial.make_grid(square, 1.0).count() == 8 and spatial.make_grid(square, 3.0).count() == 2
    far = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 0, 10)], "vertex_no int, vx int, vy int")
    assert spatial.make_grid(far, 5.0).count() == 4 and spatial.make_grid(far, 1.0).count() == 64
    px = spark.createDataFrame([(1, 1), (1, 7), (8, 8)], "y int, x int")
    assert {(r.y, r.x): r.in_aoi for r in spatial.aoi_mask(px, far).collect()} == {(1, 1): True, (1, 7): True, (8, 8): False}


def test_water_pole(spark):
    rows = [(y, x, 1 if x < 4 else 2) for y in range(3) for x in range(6)]
    m = spark.createDataFrame(rows, "y int, x int, cls int")
    assert tuple(spatial.water_pole(m, (1.0, 0.0, 10.0, 0.0, -1.0, 50.0)).first()) == (0, 0, 16, 10.0, 50.0)
    with pytest.raises(Exception, match="no stable water"):
        spatial.water_pole(m.where("cls = 2"), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)).collect()


def test_levels_of_skewed_groups(spark):
    """A value that half of the rows share, an outlier, one value alone, nulls: ranks, gaps and quantiles as numpy has them."""
    r = np.random.default_rng(2)
    groups = {"tied": np.r_[np.full(500, 3.0), r.normal(size=499), 1e9], "flat": np.full(40, 2.5), "one": [7.0], "even": r.random(800).round(2)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "model string, height_m double").repartition(4)
    got = {}
    for row in metrics.rank_sorted(df).collect():
        got.setdefault(row.model, []).append((row["rank"], row.v))
    assert {g: sorted(v) for g, v in got.items()} == {g: list(enumerate(sorted(map(float, v)), 1)) for g, v in groups.items()}
    for row in metrics.gap_statistics(df).collect():
        gaps = np.diff(np.sort(np.array(groups[row.model], float)))
        assert row.n_gaps == len(gaps) and np.allclose([row.mediana, row.p25, row.p75], np.percentile(gaps, [50, 25, 75]), atol=1e-9)
    for row in metrics.vertical_sampling(df).where("vsr IS NOT NULL").collect():
        steps = np.diff(np.unique(np.array(groups[row.model], float)))
        assert row.n_niveles == len(steps) + 1 and np.isclose(row.vsr_mediana, np.median(steps))


def test_many_windows(spark):
    """More windows than any plan constant would hold, some of them outside the rows' dates."""
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i % 50)) for i in range(200)]
    starts = [(f"w{k}", dt.date(2023, 12, 20) + dt.timedelta(days=k % 90)) for k in range(1500)]
    got = metrics.in_windows(spark.createDataFrame(rows, "n int, scene_date date"), spark.createDataFrame(starts, "window string, start date"))
    want = {w: sum(d >= s for _, d in rows) for w, s in starts}
    assert {r.window: r["count"] for r in got.groupBy("window").count().collect()} == {w: n for w, n in want.items() if n}


def test_dms(spark):
    rows = [("43°35'46.50\"N 5°43'40.94\"W",), ("  10°0'0\"S   20°30'0\"E and more",), ("43°35'46.50\" 5°43'40.94\"W",)]
    lat, lon = dms_parts(F.col("t"))
    got = spark.createDataFrame(rows, "t string").select(F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat")).collect()
    assert tuple(got[0]) == (-5.728039, 43.59625) and tuple(got[1]) == (20.5, -10.0) and tuple(got[2]) == (None, None)


def test_iso_dates(spark):
    rows = [("scene 2024-07-02T11:04:21Z",), ("Tue, 02 Jul 2024 11:04:21 GMT",), ("no date",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(iso_date(F.col("t"))).collect()] == ["2024-07-02", "2024-07-02", "no date"]


def test_catalogue_pages(spark, tmp_path):
    feature = lambda title, ident, **p: {"id": ident, "properties": {"title": title, "datetime": "2024-07-02T11:04:21Z", **p}}
    page = {"features": [
        feature("", "S2B_MSIL2A_20240702T110421_N0510", **{"s2:product_type": "S2MSI2A", "eo:cloud_cover": 12.5}),
        feature("S2A_MSIL2A_20240702T090000_N0510", "x"),
        feature("S2A_MSIL1C_20240703T110000_N0510", "y"),
    ]}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    c = readers.read_catalogue(spark, str(tmp_path))
    assert [tuple(r) for r in readers.overpass_times(c).collect()] == [(dt.date(2024, 7, 2), dt.datetime(2024, 7, 2, 11, 4, 21))]
    assert readers.overpass_times(c, earliest=True).first().dt_utc == dt.datetime(2024, 7, 2, 9, 0)
    dated = c.withColumn("scene_date", F.to_date(F.substring("datetime", 1, 10)))
    assert readers.available_dates(dated, 50).count() == 1 and readers.available_dates(dated, 10).count() == 0


def test_gauge_files(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.csv").write_text('note,"a, b",fecha,nivel_m\nx,"1, 2",2024-01-01 00:10:00,0.5\n\n"p, q",,2024-01-01 00:20:00,"-1.5"\n')
    (tmp_path / "q" / "b.csv").write_text("fecha,nivel_m\n2024-01-02 00:00:00,2\n")
    got = readers.read_gauge(spark, str(tmp_path / "q")).orderBy("datetime").collect()
    assert [r.height_m for r in got] == [0.5, -1.5, 2.0]
    (tmp_path / "g.csv").write_text("station 7\nsome note\nnivel_m,fecha\n1.25,2024-01-01 00:10:00\n-0.5,2024-01-01 00:20:00\nx,\n")
    got = readers.read_gauge(spark, str(tmp_path / "g.csv"), skiprows=2).orderBy("datetime").collect()
    assert [tuple(r) for r in got] == [(dt.datetime(2024, 1, 1, 0, 10), 1.25), (dt.datetime(2024, 1, 1, 0, 20), -0.5)]


def test_tiles_and_scene_sink(spark, tmp_path):
    scl = pixels(spark, {D1: ["66 ", "45b"], D2: ["888", "888"]})
    back = readers.tiles_to_pixels(readers.pixels_to_tiles(scl, 2))
    assert grid(back.where(F.col("scene_date") == D1), "scl", 2, 4).tolist() == [[6, 6, 0, 0], [4, 5, 11, 0]]
    path = str(tmp_path / "s")
    readers.write_scenes(scl, path)
    readers.write_scenes(scl.where(F.col("scene_date") == D2).limit(2), path)
    assert {r.scene_date: r.n for r in spark.read.parquet(path).groupBy("scene_date").agg(F.count("*").alias("n")).collect()} == {D1: 5, D2: 2}
    with pytest.raises(ValueError):
        readers.write_scenes(scl.drop("x"), path)


def test_scene_files_cover_compact_areas(spark, tmp_path):
    """A scene is several bounded files, few of which a box touches; negative places too."""
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(1024 * 1024).select(F.lit(D1).alias("scene_date"), (F.col("id") / 1024 - 512).cast("int").alias("y"), (F.col("id") % 1024).cast("int").alias("x"), F.lit(6).alias("scl"))
    path = str(tmp_path / "z")
    readers.write_scenes(rows, path, 20_000)
    files = [pq.read_table(f, columns=["y", "x"]).to_pandas() for f in glob.glob(f"{path}/*/*.parquet")]
    touched = sum(((f.y.min() < 150) & (f.y.max() >= 100) & (f.x.min() < 250) & (f.x.max() >= 200)) for f in files)
    assert len(files) > 50 and max(map(len, files)) <= 20_000 and touched <= 8
    assert spark.read.parquet(path).where("y >= 100 AND y < 150 AND x >= 200 AND x < 250").count() == 2500


def test_selected_quantiles(spark):
    """Ranks within bins, ties, negative values, zeros, tiny and huge ones, one value, none."""
    r = np.random.default_rng(3)
    groups = {"a": r.normal(0, 1, 999), "b": np.round(r.uniform(0, 30, 500)), "c": 10 ** r.uniform(-300, 300, 77) * r.choice([-1, 1], 77), "d": [5.0], "e": [0.0] * 9 + [1.0], None: [1.0, 2.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("f", None), ("a", None)]
    shares = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "top": 1.0, "low": 0.0}
    got = {x.g: x for x in quantiles.selected(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert all(math.isclose(got[g][n], np.quantile(vs, p), rel_tol=1e-12, abs_tol=1e-300) for n, p in shares.items())


def test_windows_count_samples_once(spark):
    """Metrics of nested windows from slices equal those of each window's own samples; keys may hold any sign."""
    r = np.random.default_rng(5)
    rows = [(m, dt.date(2024, 1, 1) + dt.timedelta(days=int(k)), float(h)) for m in ("a|b", "c") for k, h in zip(r.integers(0, 60, 150), np.round(r.normal(0, 1, 150), 1), strict=True)]
    starts = [("all|days", dt.date(2023, 1, 1)), ("w_b", dt.date(2024, 1, 20)), ("same", dt.date(2024, 1, 20)), ("last", dt.date(2024, 2, 25)), ("never", dt.date(2025, 1, 1))]
    samples = spark.createDataFrame(rows, "model string, scene_date date, height_m double")
    got = metrics.window_metrics(samples, samples, spark.createDataFrame(starts, "window string, start date"))
    got = {(x.window, x.model): x for x in got.collect()}
    assert len(got) == 8 and ("All|days", "a|b") in got
    for w, s in starts[:4]:
        one = metrics.full_metrics(samples.where(F.col("scene_date") >= F.lit(s)), samples, on="model")
        for x in one.collect():
            other = got[w.replace("_", " ").title() if w != "all|days" else "All|days", x.model]
            for family in ("cobertura", "uniformidad_ks", "entropia", "dispersion", "gaps", "vsr", "representatividad"):
                a, b = x[family].asDict(True), other[family].asDict(True)
                assert str(a) == str(b) or all(a[k] == b[k] or math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


@pytest.mark.parametrize("n", [401, 700, 2000])
def test_ks_expansion_against_the_exact_method(n):
    for z in np.linspace(0.3, 1.9, 17):
        d = z / math.sqrt(n)
        assert abs(metrics.ks_pvalue(d, n) - metrics._matrix_pvalue(d, n)) < 1e-6


def test_stretches(spark):
    rows = spark.createDataFrame([(D1, 0, x, float(x), None if x == 3 else 5.0, float(x % 2)) for x in range(11)], "scene_date date, y int, x int, b04 double, b03 double, b02 double")
    a = grid(bands.stretch_bands(rows), "b04", 1, 11)[0].astype(float)
    lo, hi = np.percentile(np.arange(1, 11), [2, 98])
    assert np.allclose(a, np.clip((np.arange(11) - lo) / (hi - lo), 0, 1))
    assert set(grid(bands.stretch_bands(rows), "b03", 1, 11)[0]) == {0.0}  # equal ends
    joint = bands.stretch_joint(rows)
    assert grid(joint, "b04", 1, 11)[0][3] == 0.0
    assert bands.tile_coverage(rows).first().coverage_pct == 90.91
    clipped = bands.clip_bands(spark.createDataFrame([(D1, 0, 0, 1.7, -0.2, None)], "scene_date date, y int, x int, b04 double, b03 double, b02 double")).first()
    assert (clipped.b04, clipped.b03, clipped.b02) == (255, 0, 0)


def heights(spark, values, g="a"):
    return spark.createDataFrame([(g, float(v)) for v in values], "model string, height_m double")


def test_bins_against_numpy(spark):
    r = np.random.default_rng(1)
    v = np.concatenate((r.random(2000) * 1.4 - 0.2, np.linspace(0, 1, 21), np.linspace(0, 1, 11)))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for n in (7, 10, 20, 30):
        got = df.select(histogram_bin(F.col("v"), F.lit(0.0), F.lit(1.0), n).alias("b")).where("b IS NOT NULL").groupBy("b").count().collect()
        assert {x.b: x["count"] for x in got} == {i: c for i, c in enumerate(np.histogram(v, n, (0, 1))[0].tolist()) if c}
    assert df.limit(1).select(histogram_bin(F.lit(2.0), F.lit(2.0), F.lit(2.0), 4)).first()[0] == 2


def test_ranks_and_gaps_with_ties(spark):
    v = [random.Random(2).choice((0.0, 0.5, 0.5, 3.0, 9.0)) + i % 7 for i in range(200)]
    ranks = sorted((r.rank, r.v) for r in metrics.rank_sorted(heights(spark, v)).collect())
    assert ranks == list(enumerate(sorted(v), 1))
    gaps = sorted(r.gap for r in metrics.neighbour_gaps(heights(spark, v)).collect())
    assert np.allclose(gaps, np.sort(np.diff(np.sort(v))))
    levels = sorted(r.gap for r in metrics.neighbour_gaps(heights(spark, v), distinct=True).collect())
    assert np.allclose(levels, np.sort(np.diff(np.unique(v))))


def test_ks(spark):
    v = np.random.default_rng(5).random(57) * 2
    row = metrics.uniformity_ks(heights(spark, v), heights(spark, [0, 2])).first()
    u, i = np.sort(v) / 2, np.arange(1, 58)
    assert math.isclose(row.ks_statistic, max((i / 57 - u).max(), (u - (i - 1) / 57).max()), rel_tol=1e-9)
    assert metrics.uniformity_ks(heights(spark, [1, 1, 1])).first().ks_pvalue is None


@pytest.mark.parametrize("d, n, p", [(0.274, 10, 1 - 0.628480), (0.5, 1, 1.0), (0.95, 1, 0.1), (0.409, 10, 0.05), (0.1340, 100, 0.05), (0.0608, 500, 0.049)])
def test_ks_pvalues(d, n, p):
    assert abs(metrics.ks_pvalue(d, n) - p) < 2e-3


def test_metrics_of_few_samples(spark):
    one = heights(spark, [1.0])
    assert metrics.dispersion_vmr(one).first().patron == "Indefinido"
    v = metrics.vertical_sampling(one).first()
    assert (v.vsr, v.n_niveles, v.calidad_vsr) == (None, 1, "Indefinido")
    two = metrics.dispersion_vmr(heights(spark, [1.0, 2.0])).first()
    assert (two.vmr, two.patron) == (None, "Agrupado (clustered)")
    same = metrics.dispersion_vmr(heights(spark, [1.0, 1.0, 1.0])).first()
    assert (same.vmr, same.patron) == (math.inf, "Agrupado (clustered)")


def test_verdict(spark):
    even = heights(spark, np.linspace(0, 4, 81))
    r = metrics.distribution_verdict(metrics.full_metrics(even, even)).first()
    assert (r.calidad_global, r.apta, r.recomendaciones) == ("Excelente", True, []) and r.n_criterios_cumplidos == 6
    low = metrics.distribution_verdict(metrics.full_metrics(heights(spark, [0.1, 0.1, 0.2, 0.9]), even)).first()
    assert not low.apta and low.recomendaciones[0] == "Cobertura insuficiente (20.0%). Añadir imágenes en mareas extremas."
    assert "quantiles [1, 3, 4, 5, 6, 7, 8, 9]" in low.recomendaciones[2]
    table = metrics.metric_table(metrics.distribution_verdict(metrics.full_metrics(even, even))).first()
    assert table.criterios == "6/6" and table.es_apta == "✓"


def test_table_of_two_samples(spark):
    """One bin's entropy is minus zero, one gap has no variance, and the p-value of two samples is the exact one."""
    t = metrics.metric_table(metrics.distribution_verdict(metrics.full_metrics(heights(spark, [0.1, 0.3]), heights(spark, [0, 10])))).first()
    assert (t.n_obs, t.entropia_norm, t.vmr_ratio, t.patron_tipo) == (2, "-0.000", "nan", "Agrupado")
    assert t.ks_pval == f"{2 * (1 - 0.97) ** 2:.4f}" == "0.0018"


@pytest.mark.parametrize("n", [3, 5, 7, 49, 1000])
def test_entropy_of_one_bin(spark, n):
    assert str(metrics.shannon_entropy(heights(spark, [0.1] * n), heights(spark, [0, 10])).first().entropia) == "-0.0"


def test_representativeness_without_any_inside(spark):
    r = metrics.representativeness(heights(spark, [9, 10]), heights(spark, [0, 1])).first()
    assert r.representatividad == 0.0 and r.quantiles_vacios == list(range(10))


def test_interpolations(spark):
    hours = list(range(0, 60))
    f = lambda t: 0.5 * t**3 - 20 * t**2 + t - 7
    series = spark.createDataFrame([("n", float(h), f(h) if h != 40 else None) for h in hours], "node string, t double, z double")
    times = spark.createDataFrame([("n", 5.25), ("n", 12.0), ("n", 38.5), ("n", 0.1), ("m", 3.0)], "node string, t double")
    got = {r.t: r.height_m for r in tides.interpolate(times, series).collect()}
    assert set(got) == {5.25, 12.0} and all(math.isclose(v, f(t), rel_tol=1e-9) for t, v in got.items())
    spline = {r.t: r.height_m for r in tides.interpolate_spline(times, series, 20).collect()}
    assert set(spline) == {5.25, 12.0, 38.5, 0.1} and all(math.isclose(v, f(t), rel_tol=1e-6, abs_tol=1e-6) for t, v in spline.items())


def test_nearest_nodes(spark):
    t = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 0.0)], "target string, lat double, lon double")
    n = spark.createDataFrame([(0.0, 0.6), (0.6, 0.0), (-0.9, -0.9)], "lat double, lon double")
    assert [tuple(r)[:3] for r in tides.nearest_point(t, n, 1.0).collect()] == [("a", 0.0, 0.6)]
    assert [tuple(r)[:4] for r in tides.nearest_probe(t, n, 1.0).collect()] == [("a", 1.0, 0.0, 0.6)]
    assert tides.nearest_point(t, n, 0.5).count() == 0


def test_predicted_height(spark):
    waves = spark.createDataFrame([(2.0, 30.0, 60.0, 1.1, 15.0)], "amp_m double, speed_deg_h double, phase_deg double, node_factor double, argument_deg double")
    times = spark.sql("SELECT TIMESTAMP_NTZ'2000-01-01 03:00:00' AS ts")
    assert math.isclose(tides.predict(times, waves).first().height_m, 2.2 * math.cos(math.radians(90 + 15 - 60)))


def test_errors_count_what_was_compared(spark):
    rows = spark.createDataFrame([(1.0, 1.5, None), (2.0, 1.0, 2.0), (None, 5.0, 5.0)], "observed_height_m double, got410_height_m double, cmems_height_m double")
    r = {x.model: x for x in tides.model_errors(rows).collect()}
    assert (r["got410_height_m"].mae, r["got410_height_m"].n_compared) == (0.75, 2)
    assert (r["cmems_height_m"].mae, r["cmems_height_m"].n_observed, r["cmems_height_m"].n_compared) == (0.0, 2, 1)


def test_composites_and_half_even(spark):
    takes = spark.createDataFrame([(D1, 0, 0, 4), (D1, 0, 0, 5), (D1, 0, 0, 5)], "scene_date date, y int, x int, scl int")
    assert refmap.daily_composite(takes, "scl", "mode").first().scl == 5
    assert spark.range(1).select(dataset.half_even(F.lit(0.125), 2)).first()[0] == 0.12
