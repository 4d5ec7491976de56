"""Spatial queries with their DuckDB texts. The polygon is derived from the extent of the scene grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrackline.operators import refmap, spatial
from wrackline.sources.fixtures import WIDTH, view, with_views

from .scenes import SCL, r6, scl

MAP = """, votes AS (SELECT y, x, count(*) FILTER (scl = 6) AS w, count(*) FILTER (scl IN (4, 5)) AS l FROM scl_obs GROUP BY 1, 2),
refmap AS (SELECT y, x, CASE WHEN w = 0 THEN 2 WHEN l = 0 THEN 1 ELSE 0 END AS cls FROM votes)"""
AFFINE = (0.1, 0.0, -7.0, 0.0, -0.1, 43.5)
AOI_SQL = """SELECT 0 AS vertex_no, min(x) + 4 AS vx, min(y) + 4 AS vy FROM {t} UNION ALL SELECT 1, max(x) - 3, min(y) + 6 FROM {t}
UNION ALL SELECT 2, max(x) - 11, max(y) - 3 FROM {t} UNION ALL SELECT 3, min(x) + 8, max(y) - 7 FROM {t}"""
AOI = ", aoi AS (" + AOI_SQL.format(t="scl_obs") + ")"
EDGES = AOI + ", edge AS (SELECT a.vx AS x1, a.vy AS y1, b.vx AS x2, b.vy AS y2 FROM aoi a JOIN aoi b ON b.vertex_no = (a.vertex_no + 1) % 4)"
MIN_OBS, CLEAR_VIEWS = 3, 12
FREQ = f""", fv AS (SELECT y, x, count(*) FILTER (scl = 6) AS w, count(*) FILTER (scl IN (4, 5, 6)) AS c FROM scl_obs GROUP BY 1, 2),
freq AS (SELECT y, x, CASE WHEN c >= {MIN_OBS} THEN w / c END AS water_freq FROM fv)"""

SPARSE = FREQ.replace(f"c >= {MIN_OBS}", f"c >= {CLEAR_VIEWS}")


def comp(name: str, pixels: str) -> str:
    """CTEs that label the 4-connected parts of a pixel set: {name} (y, x, component, size)."""
    return f""", {name}_p AS ({pixels}), {name}_e AS (SELECT a.y * {WIDTH} + a.x AS a, b.y * {WIDTH} + b.x AS b FROM {name}_p a JOIN {name}_p b ON abs(a.y - b.y) + abs(a.x - b.x) <= 1),
{name}_r AS (SELECT a, b FROM {name}_e UNION SELECT r.a, e.b FROM {name}_r r JOIN {name}_e e ON e.a = r.b),
{name}_l AS (SELECT a, min(b) AS component FROM {name}_r GROUP BY 1), {name}_s AS (SELECT component, count(*) AS size FROM {name}_l GROUP BY 1),
{name} AS (SELECT CAST(a // {WIDTH} AS INT) AS y, CAST(a % {WIDTH} AS INT) AS x, CAST(component AS BIGINT) AS component, size FROM {name}_l JOIN {name}_s USING (component))"""


REC = SCL.replace("WITH ", "WITH RECURSIVE ", 1)
SPECK = comp("sp", "SELECT y, x FROM freq WHERE water_freq IS NOT NULL") + ", f1 AS (SELECT y, x, CASE WHEN size >= 6 THEN water_freq END AS water_freq FROM freq LEFT JOIN sp USING (y, x))"


def isolated(source: str, out: str) -> str:
    return comp("iw", f"SELECT y, x FROM {source} WHERE coalesce(water_freq, 0) > 0.15") + f", {out} AS (SELECT y, x, CASE WHEN size < 20 THEN 0 ELSE water_freq END AS water_freq FROM {source} LEFT JOIN iw USING (y, x))"


INSIDE = """(SELECT count(*) FROM edge WHERE y1 <> y2 AND (y1 > {y}) <> (y2 > {y}) AND {x} < x1 + ({y} - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1"""


def aoi(s, d):
    rows = scl(s, d)
    return s.sql(AOI_SQL, t=rows)


def local_map(s, d):
    """The map of all scenes without a coastal strip."""
    return refmap.reference_map_local(scl(s, d), 0.98, 0)


def frequency(s, d):
    """Water frequency of all scenes; pixels with fewer than CLEAR_VIEWS clear views are unknown, so that islands occur."""
    return refmap.water_frequency(scl(s, d), CLEAR_VIEWS)


def water(s, d):
    return local_map(s, d).select("y", "x", (F.col("cls") == 1).alias("inside"))


def transition(s, d):
    return local_map(s, d).where("cls = 0").select("y", "x")


DIST = ", dt AS (SELECT a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d2 FROM refmap a JOIN refmap b ON b.cls <> 1 GROUP BY 1, 2)"
POLE = " SELECT y, x, CAST(d2 AS BIGINT) AS d2{more} FROM dt ORDER BY d2 DESC, y, x LIMIT 1"


def q_polygon(s, d):
    v = aoi(s, d)
    text = F.format_string("%d°%d'%d.5\"N %d°%d'%d.25\"W", F.col("vy").cast("int"), F.col("vx").cast("int") % 60, F.col("vertex_no"), F.col("vx").cast("int"), F.col("vy").cast("int") % 60, F.col("vertex_no"))
    ring = spatial.make_polygon(v.select("vertex_no", text.alias("dms")))
    return r6(ring.select(F.posexplode("ring").alias("vertex_no", "v")).select("vertex_no", F.col("v.lon").alias("lon"), F.col("v.lat").alias("lat")), "lon", "lat")


def q_grid(s, d):
    """Cells of 8 that touch the polygon."""
    return spatial.make_grid(aoi(s, d), 8.0)


def q_rings(s, d):
    return spatial.rings(transition(s, d), WIDTH)


def q_extent(s, d):
    grid = scl(s, d).groupBy("scene_date").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    grid = grid.select("scene_date", "height", "width", F.lit(0.1).alias("a"), F.lit(-7.0).alias("c"), F.lit(-0.1).alias("e"), F.lit(43.5).alias("f"))
    return r6(spatial.raster_extent(grid), "left", "right", "bottom", "top")


QUERIES = {
    "pixel_to_coord": (
        lambda s, d: r6(spatial.pixel_to_coord(scl(s, d).select("y", "x").distinct(), AFFINE, "center"), "lon", "lat"),
        f"{SCL} SELECT DISTINCT y, x, round(-7.0::DOUBLE + 0.1 * (x + 0.5), 6) AS lon, round(43.5::DOUBLE - 0.1 * (y + 0.5), 6) AS lat FROM scl_obs",
    ),
    "raster_extent": (
        q_extent,
        f"{SCL} SELECT -7.0::DOUBLE AS left, round(-7.0::DOUBLE + 0.1 * (max(x) + 1), 6) AS right, round(43.5::DOUBLE - 0.1 * (max(y) + 1), 6) AS bottom, 43.5::DOUBLE AS top FROM scl_obs GROUP BY scene_date",
    ),
    "column_distance": (
        lambda s, d: spatial.column_distance(water(s, d)),
        f"{SCL}{MAP} SELECT a.y, a.x, a.cls = 1 AS inside, min(abs(a.y - b.y)) AS gap FROM refmap a LEFT JOIN refmap b ON b.x = a.x AND b.cls <> 1 GROUP BY 1, 2, 3",
    ),
    "argmax_pixel": (lambda s, d: spatial.argmax_pixel(spatial.distance_transform(water(s, d)), "d2"), f"{SCL}{MAP}{DIST}" + POLE.format(more="")),
    "union_transition": (
        lambda s, d: transition(s, d).unionByName(spatial.within_radius(local_map(s, d), local_map(s, d).where("cls = 1"), 2)).distinct(),
        f"{SCL}{MAP} SELECT y, x FROM refmap WHERE cls = 0 UNION SELECT a.y, a.x FROM refmap a JOIN refmap b ON b.cls = 1 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4",
    ),
    "intersect_mask": (
        lambda s, d: transition(s, d).intersect(scl(s, d).where(F.col("scl").isin(3, 8, 9, 10, 11)).select("y", "x")),
        f"{SCL}{MAP} SELECT y, x FROM refmap WHERE cls = 0 INTERSECT SELECT y, x FROM scl_obs WHERE scl IN (3, 8, 9, 10, 11)",
    ),
    "distance_transform": (lambda s, d: spatial.distance_transform(water(s, d)), f"{SCL}{MAP}{DIST} SELECT y, x, CAST(d2 AS BIGINT) AS d2 FROM dt"),
    "within_radius": (
        lambda s, d: spatial.within_radius(local_map(s, d), local_map(s, d).where("cls = 2"), 4),
        f"{SCL}{MAP} SELECT DISTINCT a.y, a.x FROM refmap a JOIN refmap b ON b.cls = 2 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 16",
    ),
    "dilate": (
        lambda s, d: spatial.dilate(transition(s, d), local_map(s, d), 3),
        f"{SCL}{MAP} SELECT DISTINCT a.y, a.x FROM refmap a JOIN refmap b ON b.cls = 0 AND abs(a.y - b.y) + abs(a.x - b.x) <= 3",
    ),
    "water_pole": (
        lambda s, d: r6(spatial.water_pole(local_map(s, d), AFFINE), "lon", "lat"),
        f"{SCL}{MAP}{DIST}" + POLE.format(more=", round(-7.0::DOUBLE + 0.1 * x, 6) AS lon, round(43.5::DOUBLE - 0.1 * y, 6) AS lat"),
    ),
    "polygon_centroid": (
        lambda s, d: r6(spatial.polygon_centroid(aoi(s, d)), "cx", "cy"),
        f"{SCL}{EDGES}, c AS (SELECT x1 * y2 - x2 * y1 AS k, * FROM edge) SELECT round(sum((x1 + x2) * k) / (3 * sum(k)), 6) AS cx, round(sum((y1 + y2) * k) / (3 * sum(k)), 6) AS cy FROM c",
    ),
    "make_polygon": (
        q_polygon,
        f"""{SCL}{AOI} SELECT vertex_no, round(-(vx + (vy % 60) / 60 + (vertex_no + 0.25::DOUBLE) / 3600), 6) AS lon, round(vy + (vx % 60) / 60 + (vertex_no + 0.5::DOUBLE) / 3600, 6) AS lat FROM aoi""",
    ),
    "polygon_bbox": (lambda s, d: spatial.polygon_bbox(aoi(s, d)), f"{SCL}{AOI} SELECT min(vx) AS west, min(vy) AS south, max(vx) AS east, max(vy) AS north FROM aoi"),
    "make_grid": (
        q_grid,
        f"""{SCL}{EDGES}, b AS (SELECT min(vx) AS w, min(vy) AS s, max(vx) AS e, max(vy) AS n FROM aoi),
c AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, (w + i * 8)::DOUBLE AS x0, (s + j * 8)::DOUBLE AS y0, (w + i * 8 + 8)::DOUBLE AS gx, (s + j * 8 + 8)::DOUBLE AS gy
  FROM b, range(100) a(i), range(100) c(j) WHERE w + i * 8 < e AND s + j * 8 < n),
m AS (SELECT DISTINCT i, j FROM (SELECT *, [{", ".join(f"sign((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))" for x in ("x0", "gx") for y in ("y0", "gy"))}] AS k FROM c, edge)
  WHERE (x1 BETWEEN x0 AND gx AND y1 BETWEEN y0 AND gy) OR (list_min(k) <= 0 AND list_max(k) >= 0 AND least(x1, x2) <= gx AND greatest(x1, x2) >= x0 AND least(y1, y2) <= gy AND greatest(y1, y2) >= y0))
SELECT i, j, x0, y0, gx AS x1, gy AS y1 FROM c WHERE (i, j) IN (SELECT (i, j) FROM m) OR {" OR ".join("(" + INSIDE.format(x=f"c.{x}", y=f"c.{y}") + ")" for x in ("x0", "gx") for y in ("y0", "gy"))}""",
    ),
    "aoi_mask": (
        lambda s, d: spatial.aoi_mask(scl(s, d).select("y", "x").distinct(), aoi(s, d)),
        f"{SCL}{EDGES}, f AS (SELECT DISTINCT y, x FROM scl_obs) SELECT y, x, {INSIDE.format(x='(f.x + 0.5::DOUBLE)', y='(f.y + 0.5::DOUBLE)')} AS in_aoi FROM f",
    ),
    "bbox_filter": (
        lambda s, d: spatial.bbox_filter(scl(s, d), (10, 5, 30, 20), "1995-03-01", "1996-02-01"),
        f"{SCL} SELECT * FROM scl_obs WHERE x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 20 AND scene_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-01'",
    ),
    "transition_geometry": (
        q_rings,
        f"""{REC}{MAP}, t AS (SELECT y, x FROM refmap WHERE cls = 0), s AS (
SELECT y, x, -1 AS dy, 0 AS dx, x AS x1, y AS y1, x + 1 AS x2, y AS y2, 0 AS side FROM t UNION ALL SELECT y, x, 0, 1, x + 1, y, x + 1, y + 1, 1 FROM t
UNION ALL SELECT y, x, 1, 0, x + 1, y + 1, x, y + 1, 2 FROM t UNION ALL SELECT y, x, 0, -1, x, y + 1, x, y, 3 FROM t),
e AS (SELECT x1, y1, x2, y2, (y1::BIGINT * {WIDTH + 1} + x1) * 4 + side AS id FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.y = s.y + s.dy AND t.x = s.x + s.dx)),
nx AS (SELECT a.id, arg_max(b.id, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS next FROM e a JOIN e b ON b.x1 = a.x2 AND b.y1 = a.y2 GROUP BY 1),
walk AS (SELECT id AS start, id, 0 AS pos FROM nx UNION ALL SELECT start, next, pos + 1 FROM walk JOIN nx USING (id) WHERE next > start)
SELECT start AS ring, pos::BIGINT AS pos, x1 AS x, y1 AS y FROM walk JOIN e USING (id) WHERE start IN (SELECT w.start FROM walk w JOIN nx USING (id) WHERE next = w.start)""",
    ),
    "despeckle": (lambda s, d: r6(spatial.despeckle(frequency(s, d), WIDTH), "water_freq"), f"{REC}{SPARSE}{SPECK} SELECT y, x, round(water_freq, 6) AS water_freq FROM f1"),
    "connected_components": (
        lambda s, d: spatial.connected_components(frequency(s, d).where("water_freq IS NOT NULL").select("y", "x"), WIDTH, 8),
        f"{REC}{SPARSE}{comp('sp', 'SELECT y, x FROM freq WHERE water_freq IS NOT NULL')} SELECT * FROM sp",
    ),
    "remove_isolated_water": (
        lambda s, d: r6(spatial.remove_isolated_water(frequency(s, d), WIDTH), "water_freq"),
        f"{REC}{SPARSE}{isolated('freq', 'f2')} SELECT y, x, round(water_freq, 6) AS water_freq FROM f2",
    ),
    "clean_water_frequency": (
        lambda s, d: r6(spatial.clean_water_frequency(frequency(s, d), aoi(s, d), WIDTH), "water_freq"),
        f"""{REC}{SPARSE}{SPECK}{isolated("f1", "f2")}{EDGES} SELECT y, x, CASE WHEN {INSIDE.format(x="(f2.x + 0.5::DOUBLE)", y="(f2.y + 0.5::DOUBLE)")} THEN round(water_freq, 6) END AS water_freq FROM f2""",
    ),
    "contour_cells": (
        lambda s, d: r6(spatial.contour_cells(refmap.water_frequency(scl(s, d), MIN_OBS)), "top", "bottom", "left", "right"),
        f"""{SCL}{FREQ}, v AS (SELECT * FROM freq WHERE water_freq IS NOT NULL),
c AS (SELECT a.y, a.x, a.water_freq AS v00, b.water_freq AS v01, e.water_freq AS v10, f.water_freq AS v11 FROM v a JOIN v b ON b.y = a.y AND b.x = a.x + 1
  JOIN v e ON e.y = a.y + 1 AND e.x = a.x JOIN v f ON f.y = a.y + 1 AND f.x = a.x + 1)
SELECT y, x, {", ".join(f"CASE WHEN ({a} < 0.5) <> ({b} < 0.5) THEN round((0.5::DOUBLE - {a}) / ({b} - {a}), 6) END AS {n}" for n, a, b in (("top", "v00", "v01"), ("bottom", "v10", "v11"), ('"left"', "v00", "v10"), ('"right"', "v01", "v11")))}
FROM c WHERE least(v00, v01, v10, v11) < 0.5 AND greatest(v00, v01, v10, v11) >= 0.5""",
    ),
    "aoi_extent_pad": (
        lambda s, d: r6(spatial.extent_pad(aoi(s, d)), "left", "right", "bottom", "top"),
        f"""{SCL}{AOI}, b AS (SELECT min(vx)::DOUBLE AS w, min(vy)::DOUBLE AS s, max(vx)::DOUBLE AS e, max(vy)::DOUBLE AS n FROM aoi)
SELECT round(w - (e - w) * 0.05, 6) AS "left", round(e + (e - w) * 0.05, 6) AS "right", round(s - (n - s) * 0.05, 6) AS bottom, round(n + (n - s) * 0.05, 6) AS top FROM b""",
    ),
}
