"""Queries over scenes: sources, quality, reference maps, bands, dataset. Each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrackline.functions.expressions import decimal_hour, dms_parts
from wrackline.operators import bands, dataset, quality, refmap
from wrackline.sources import readers, tiled
from wrackline.sources.fixtures import view, with_views
from wrackline.sources.scratch import scratch

BAD = "(3, 8, 9, 10, 11)"
DATES = ["1995-02-01", "1996-05-01", "1997-07-01"]
QUAL = f", qual AS (SELECT scene_date, count(*) AS total, count(*) FILTER (scl IN {BAD}) AS nbad FROM scl_obs GROUP BY 1)"
MAP = (
    QUAL
    + """, votes AS (SELECT y, x, count(*) FILTER (scl = 6) AS w, count(*) FILTER (scl IN (4, 5)) AS l FROM scl_obs
  WHERE scene_date IN (SELECT scene_date FROM qual WHERE nbad / total <= 0.05) GROUP BY 1, 2),
frame AS (SELECT DISTINCT y, x FROM scl_obs),
kinds AS (SELECT y, x, coalesce(w, 0) AS w, coalesce(l, 0) AS l, coalesce(w / greatest(w + l, 1), 0) AS pw, coalesce(l / greatest(w + l, 1), 0) AS pl
  FROM frame LEFT JOIN votes USING (y, x)),
kk AS (SELECT *, CASE WHEN pl >= 0.95 THEN 2 WHEN pw >= 0.95 THEN 1 ELSE 0 END AS kind FROM kinds),
wide AS (SELECT DISTINCT a.y, a.x FROM kk a JOIN kk b ON b.kind = 0 AND abs(a.y - b.y) + abs(a.x - b.x) <= 5),
refmap AS (SELECT kk.y, kk.x, CASE WHEN wide.y IS NOT NULL THEN 0 ELSE kind END AS cls, w, l, pw, pl FROM kk LEFT JOIN wide ON wide.y = kk.y AND wide.x = kk.x)"""
)
SCORE = (
    MAP
    + f""", sums AS (SELECT scene_date, count(*) AS n, count(*) FILTER (scl IN {BAD}) AS nb, count(*) FILTER (cls = 0) AS t,
    count(*) FILTER (cls = 0 AND scl IN {BAD}) AS tb FROM scl_obs LEFT JOIN refmap USING (y, x) GROUP BY 1),
score AS (SELECT scene_date, round(nb / n * 100, 4) AS global_pct,
    round(CASE WHEN nb / n <= 0.05 THEN nb / n ELSE tb / greatest(t, 1) END * 100, 4) AS cloud_pct FROM sums),
classed AS (SELECT *, CASE WHEN cloud_pct / 100 <= 0.05 THEN 'reference' WHEN cloud_pct / 100 <= 0.10 THEN 'recovered' ELSE 'discarded' END AS status FROM score)"""
)
SCL = with_views("scl_obs")
RGB = with_views("rgb_obs")
CAT = with_views("catalogue")
COVER = ", cover AS (SELECT scene_date, round(100.0 * count(*) FILTER (b04 IS NOT NULL AND b03 IS NOT NULL AND b02 IS NOT NULL) / count(*), 2) AS coverage_pct FROM rgb_obs GROUP BY 1)"


def scl(s, d):
    return view(s, d, "scl_obs")


def clean_map(s, d):
    return refmap.reference_map_clean(scl(s, d))


def with_clean_map(operator):
    """An operator of scenes and their map. The scenes are stored once by tile; map and operator both read them there."""

    def run(s, d):
        scenes = tiled.store_tiled(scl(s, d))
        return operator(scenes, refmap.reference_map_clean(scenes))

    return run


score = with_clean_map(quality.scene_cloud_score)


def titled(s, d):
    """The catalogue with product titles as harvested pages have them."""
    stamp = F.date_format("dt_utc", "yyyyMMdd'T'HHmmss")
    kind = F.when(F.col("product_type") == "S2MSI2A", "MSIL2A").otherwise("MSIL1C")
    return view(s, d, "catalogue").withColumn("title", F.concat(F.lit("S2B_"), kind, F.lit("_"), stamp, F.lit("_N0510_R037_T29TPJ")))


def overpass(s, d):
    return readers.overpass_times(titled(s, d))


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def q_tiles(s, d):
    return readers.tiles_to_pixels(readers.pixels_to_tiles(scl(s, d), 16)).select("scene_date", "y", "x", "scl")


def q_scan_map(s, d):
    from wrackline.operators.spatial import pixel_to_coord

    m = clean_map(s, d).select("y", "x", F.col("cls").cast("int").alias("cls"))
    return r6(pixel_to_coord(m, (0.1, 0.0, -7.0, 0.0, -0.1, 43.5)), "lon", "lat")


def q_gauge(s, d):
    path = scratch(s, "gauge")
    view(s, d, "observed").select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("fecha"), F.col("height_m").alias("nivel_m")).write.option("header", True).csv(path)
    return r6(readers.read_gauge(s, path), "height_m")


def q_iso(s, d):
    c = view(s, d, "catalogue")
    label = F.when(F.col("seq") % 3 == 0, F.date_format("dt_utc", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("seq") % 3 == 1, F.concat(F.date_format("dt_utc", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return readers.normalised_dates(c.select(F.coalesce(label, F.concat(F.lit("scene "), "product_type")).alias("label")), "label")


def q_pending(s, d):
    rows = scl(s, d)
    done = quality.filter_by_quality(rows).where("status = 'valid'")
    return readers.pending_dates(rows, done)


def index(s, d):
    from wrackline.operators.tides import predict

    cat = view(s, d, "catalogue")
    over = overpass(s, d)
    tide = predict(over.select(F.col("dt_utc").alias("ts")), view(s, d, "constituents")).withColumnRenamed("ts", "dt_utc")
    cloud = cat.groupBy("scene_date").agg(F.min("cloud_cover").alias("cloud_pct"))
    cover = cat.groupBy("scene_date").agg((F.count("*") % 100).cast("double").alias("coverage_pct"))
    return dataset.assemble(readers.available_dates(cat, 60.0), over, tide, cloud, cover)


def q_index_columns(s, d):
    return dataset.index_columns(index(s, d), 43.593075, -7.225533)


def q_dataset_sink(s, d):
    path = scratch(s, "index")
    rows = q_index_columns(s, d)
    readers.write_index(rows, path)
    return s.read.schema(rows.schema).option("header", True).csv(path).select("fecha", "hora_utc", "imagen_rgb", "nubes_pct", "cobertura_tile_pct", "lat")


def q_raster_sink(s, d):
    path = scratch(s, "scenes")
    readers.write_scenes(scl(s, d), path)
    return s.read.parquet(path).select("scene_date", "y", "x", "scl")


def q_time_grid(s, d):
    ends = view(s, d, "tide_reference").groupBy("model").agg(F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz").alias("a"), F.date_trunc("DAY", F.max("ts")).cast("timestamp_ntz").alias("b"))
    return ends.select("model", F.explode(F.sequence("a", "b", F.expr("INTERVAL 2 HOURS"))).alias("ts"))


def q_scl_quality(s, d):
    q = quality.scene_quality(scl(s, d))
    text = F.array_join(F.transform(F.map_entries("class_counts"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return r6(q.withColumn("class_counts", text), "bad_fraction", "bad_pct")


def q_local_map(s, d):
    return r6(refmap.reference_map_local(scl(s, d), 0.98, 3).withColumn("cls", F.col("cls").cast("int")), "p_water", "p_land")


def q_clean_map(s, d):
    return r6(clean_map(s, d).withColumn("cls", F.col("cls").cast("int")), "p_water", "p_land")


def freq(s, d, min_obs=8):
    return refmap.water_frequency(scl(s, d), min_obs)


def q_dms(names):
    def run(s, d):
        o = s.read.parquet(f"{d}/orders.parquet")
        text = F.format_string("%d°%d'%d.%d\"%s %d°%d'%d.%d\"%s", F.col("o_orderkey") % 90, F.col("o_custkey") % 60, F.col("o_orderkey") % 59, F.col("o_custkey") % 10, F.when(F.col("o_orderkey") % 2 == 0, "N").otherwise("S"), F.col("o_orderkey") % 180, F.col("o_custkey") % 59, F.col("o_orderkey") % 57, F.col("o_custkey") % 9, F.when(F.col("o_custkey") % 2 == 0, "E").otherwise("W"))
        lat, lon = dms_parts(text)
        cols = {"lat": F.round(lat, 6), "lon": F.round(lon, 6)}
        return o.select("o_orderkey", *[cols[n].alias(n) for n in names])

    return run


DMS_SQL = """SELECT o_orderkey,
  round((o_orderkey % 90 + (o_custkey % 60) / 60 + (o_orderkey % 59 + (o_custkey % 10) / 10) / 3600) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END, 6) AS lat,
  round((o_orderkey % 180 + (o_custkey % 59) / 60 + (o_orderkey % 57 + (o_custkey % 9) / 10) / 3600) * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END, 6) AS lon
FROM orders"""
OVER_SQL = ", over AS (SELECT CAST(dt AS DATE) AS scene_date, arg_min(dt, seq) AS dt_utc FROM (SELECT date_trunc('second', dt_utc) AS dt, seq FROM catalogue WHERE product_type = 'S2MSI2A') GROUP BY 1)"
INDEX_SQL = (
    with_views("catalogue", "constituents")
    + OVER_SQL
    + """, tide AS (SELECT dt_utc, sum(amp_m * cos(radians((speed_deg_h * h) % 360 - phase_deg))) AS height_m
  FROM (SELECT dt_utc, date_diff('second', TIMESTAMP '2000-01-01', dt_utc) / 3600 AS h FROM over), constituents GROUP BY 1),
idx AS (SELECT o.scene_date, o.dt_utc, height_m, cloud_pct, coverage_pct FROM over o JOIN tide USING (dt_utc)
  JOIN (SELECT DISTINCT scene_date FROM catalogue WHERE product_type = 'S2MSI2A' AND coalesce(cloud_cover, 100) <= 60) USING (scene_date)
  LEFT JOIN (SELECT scene_date, min(cloud_cover) AS cloud_pct, CAST(count(*) % 100 AS DOUBLE) AS coverage_pct FROM catalogue GROUP BY 1) c USING (scene_date))"""
)
_IN = "scene_date IN (DATE '1995-02-01', DATE '1996-05-01', DATE '1997-07-01')"
_STRETCH = "CASE WHEN {b} IS NULL OR NOT (p[2] > p[1]) THEN 0 ELSE greatest(0, least(1, ({b} - p[1]) / (p[2] - p[1]))) END"
_WHOLE = "b04 IS NOT NULL AND b03 IS NOT NULL AND b02 IS NOT NULL"
_JOINT = f""", ends AS (SELECT scene_date, quantile_cont(v, [0.02, 0.98]) AS p FROM (
  SELECT scene_date, unnest([b04, b03, b02]) AS v FROM rgb_obs WHERE {_WHOLE}) GROUP BY 1),
st AS (SELECT scene_date, y, x, {", ".join(f"CASE WHEN {_WHOLE} THEN {_STRETCH.format(b=b)} ELSE 0 END AS {b}" for b in ("b04", "b03", "b02"))}
  FROM rgb_obs LEFT JOIN ends USING (scene_date))"""

#: Name: query, DuckDB text.
QUERIES = {
    "scan_scl_stack": (lambda s, d: readers.scan_stack(scl(s, d), DATES), f"{SCL} SELECT scene_date, y, x, scl FROM scl_obs WHERE {_IN}"),
    "scan_scl_scene": (lambda s, d: readers.scan_scene(scl(s, d), DATES[0], "scl"), f"{SCL} SELECT scene_date, y, x, scl FROM scl_obs WHERE scene_date = DATE '{DATES[0]}'"),
    "scan_rgb_scene": (lambda s, d: readers.scan_scene(view(s, d, "rgb_obs"), DATES[0], "b04", "b03"), f"{RGB} SELECT scene_date, y, x, b04, b03 FROM rgb_obs WHERE scene_date = DATE '{DATES[0]}'"),
    "tile_to_pixels": (
        q_tiles,
        f"""{SCL}, t AS (SELECT DISTINCT scene_date, y // 16 * 16 AS r, x // 16 * 16 AS c FROM scl_obs),
g AS (SELECT scene_date, CAST(r + a AS INT) AS y, CAST(c + b AS INT) AS x FROM t, range(16) i(a), range(16) j(b))
SELECT scene_date, y, x, coalesce(scl, 0) AS scl FROM g LEFT JOIN scl_obs USING (scene_date, y, x)""",
    ),
    "scan_reference_map": (q_scan_map, f"{SCL}{MAP} SELECT y, x, cls, round(-7.0::DOUBLE + 0.1 * x, 6) AS lon, round(43.5::DOUBLE - 0.1 * y, 6) AS lat FROM refmap"),
    "scan_gauge": (q_gauge, f"{with_views('observed')} SELECT datetime, round(height_m, 6) AS height_m FROM observed"),
    "stac_overpass": (overpass, f"{CAT}{OVER_SQL} SELECT * FROM over"),
    "stac_available_dates": (lambda s, d: readers.available_dates(view(s, d, "catalogue"), 40.0), f"{CAT} SELECT DISTINCT scene_date FROM catalogue WHERE product_type = 'S2MSI2A' AND coalesce(cloud_cover, 100) <= 40"),
    "iso_date_normalise": (q_iso, f"{CAT} SELECT DISTINCT CASE WHEN seq % 3 = 2 THEN 'scene ' || product_type ELSE strftime(dt_utc, '%Y-%m-%d') END AS iso_date FROM catalogue"),
    "pending_dates": (q_pending, f"{SCL}{QUAL} SELECT scene_date FROM qual WHERE nbad / total > 0.2"),
    "dataset_sink": (
        q_dataset_sink,
        f"""{INDEX_SQL} SELECT scene_date AS fecha, strftime(dt_utc, '%H:%M:%S') AS hora_utc, 'rgb_png/rgb_' || strftime(scene_date, '%Y-%m-%d') || '.png' AS imagen_rgb,
round(cloud_pct, 2) AS nubes_pct, coverage_pct AS cobertura_tile_pct, 43.593075::DOUBLE AS lat FROM idx""",
    ),
    "raster_sink": (q_raster_sink, f"{SCL} SELECT scene_date, y, x, scl FROM scl_obs"),
    "png_frame_index": (
        lambda s, d: readers.frame_paths(view(s, d, "catalogue").select("scene_date").distinct()),
        f"""{CAT}, t AS (SELECT DISTINCT scene_date, strftime(scene_date, '%Y-%m-%d') AS k FROM catalogue)
SELECT scene_date, 'rgb_png/rgb_' || k || '.png' AS imagen_rgb, 'scl_png/scl_' || k || '.png' AS imagen_scl, 'rgb/rgb_' || k || '.tif' AS imagen_rgb_tif, 'scl/scl_' || k || '.tif' AS imagen_scl_tif FROM t""",
    ),
    "time_grid": (
        q_time_grid,
        f"{with_views('tide_reference')} SELECT model, unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP), CAST(date_trunc('day', max(ts)) AS TIMESTAMP), INTERVAL 2 HOURS)) AS ts FROM tide_reference GROUP BY model",
    ),
    "scene_validity": (lambda s, d: quality.scene_validity(view(s, d, "rgb_obs"), "b04"), f"{RGB} SELECT scene_date, max(b04) > 0 AND count(*) = count(b04) AS valid FROM rgb_obs GROUP BY 1"),
    "filter_scenes_by_quality": (
        lambda s, d: r6(quality.filter_by_quality(scl(s, d)), "bad_fraction"),
        f"{SCL}{QUAL} SELECT scene_date, round(nbad / total, 6) AS bad_fraction, CASE WHEN nbad / total <= 0.2 THEN 'valid' ELSE 'discarded' END AS status FROM qual",
    ),
    "intertidal_mask": (
        lambda s, d: refmap.intertidal_mask(freq(s, d)),
        f"""{SCL}, v AS (SELECT y, x, count(*) FILTER (scl = 6) AS w, count(*) FILTER (scl IN (4, 5, 6)) AS c FROM scl_obs GROUP BY 1, 2)
SELECT y, x, c >= 8 AND w / greatest(c, 1) BETWEEN 0.10 AND 0.95 AS intertidal FROM v""",
    ),
    "correct_scl": (
        with_clean_map(quality.correct_scl),
        f"""{SCL}{MAP} SELECT scene_date, y, x, scl, CASE WHEN scl IN (3, 8, 9, 10) AND cls = 1 THEN 6 WHEN scl IN (3, 8, 9, 10) AND cls = 2 THEN 5 ELSE scl END AS scl_corrected
FROM scl_obs JOIN refmap USING (y, x)""",
    ),
    "classify_dates": (lambda s, d: quality.classify_dates(score(s, d)), f"{SCL}{SCORE} SELECT scene_date, cloud_pct, status FROM classed"),
    "scl_legend": (
        lambda s, d: bands.classes_present(scl(s, d).select((F.col("scl") + F.when(F.col("y") == 0, 20).otherwise(0)).alias("scl"))),
        f"""{SCL}, c AS (SELECT DISTINCT scl + CASE WHEN y = 0 THEN 20 ELSE 0 END AS scl FROM scl_obs),
leg AS (SELECT * FROM (VALUES {", ".join(f"({r[0]}, '{r[1]}', '{r[2]}')" for r in bands.SCL_LEGEND)}) AS t(scl, label, colour))
SELECT scl, coalesce(label, 'Clase ' || scl) AS label, coalesce(colour, '#aaaaaa') AS colour, scl IN {BAD} AS bad FROM c LEFT JOIN leg USING (scl)""",
    ),
    "scl_colourise": (
        lambda s, d: bands.colourise(scl(s, d).withColumn("scl", F.when(F.col("y") == 1, F.lit(None)).when(F.col("y") == 2, 77).otherwise(F.col("scl")))),
        f"""{SCL}, c AS (SELECT scene_date, y, x, CASE WHEN y = 1 THEN 0 WHEN y = 2 THEN 77 ELSE scl END AS scl FROM scl_obs),
leg AS (SELECT * FROM (VALUES {", ".join(f"({r[0]}, {r[3]}, {r[4]}, {r[5]})" for r in bands.SCL_LEGEND)}) AS t(scl, r, g, b))
SELECT scene_date, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM c LEFT JOIN leg USING (scl)""",
    ),
    "coverage_filter": (
        lambda s, d: bands.coverage_filter(bands.tile_coverage(view(s, d, "rgb_obs"))),
        f"{RGB}{COVER} SELECT scene_date, coverage_pct, CASE WHEN coverage_pct >= 95 THEN 'complete' WHEN coverage_pct >= 50 THEN 'partial' ELSE 'poor' END AS kind FROM cover",
    ),
    "dms_to_coords": (q_dms(("lon", "lat")), DMS_SQL),
    "dms_to_decimal": (q_dms(("lat", "lon")), DMS_SQL),
    "date_semi_filter": (
        lambda s, d: refmap.date_semi_filter(scl(s, d), quality.filter_by_quality(scl(s, d)).where("status = 'valid'")).select("scene_date", "y", "x", "scl"),
        f"{SCL}{QUAL} SELECT scene_date, y, x, scl FROM scl_obs WHERE scene_date IN (SELECT scene_date FROM qual WHERE nbad / total <= 0.2)",
    ),
    "decimal_hour": (
        lambda s, d: view(s, d, "catalogue").select("seq", F.round(decimal_hour(F.col("dt_utc")), 6).alias("hour")),
        f"{CAT} SELECT seq, round(hour(dt_utc) + minute(dt_utc) / 60 + second(dt_utc) / 3600, 6) AS hour FROM catalogue",
    ),
    "clip_bands": (
        lambda s, d: bands.clip_bands(r6(bands.stretch_joint(view(s, d, "rgb_obs")), "b04", "b03", "b02")),
        f"{RGB}{_JOINT} SELECT scene_date, y, x, {', '.join(f'CAST(floor(round({b}, 6) * 255) AS INT) AS {b}' for b in ('b04', 'b03', 'b02'))} FROM st",
    ),
    "tide_dataset_columns": (
        q_index_columns,
        f"""{INDEX_SQL}, k AS (SELECT *, strftime(scene_date, '%Y-%m-%d') AS k FROM idx)
SELECT scene_date AS fecha, strftime(dt_utc, '%H:%M:%S') AS hora_utc, strftime(dt_utc, '%Y-%m-%dT%H:%M:%S') AS datetime_utc, 'rgb_png/rgb_' || k || '.png' AS imagen_rgb,
'scl_png/scl_' || k || '.png' AS imagen_scl, round(height_m, 3) AS marea_m, round(cloud_pct, 2) AS nubes_pct, coverage_pct AS cobertura_tile_pct, 43.593075::DOUBLE AS lat,
(-7.225533)::DOUBLE AS lon, 'rgb/rgb_' || k || '.tif' AS imagen_rgb_tif, 'scl/scl_' || k || '.tif' AS imagen_scl_tif FROM k""",
    ),
    "overpass_selected": (
        lambda s, d: overpass(s, d).join(readers.available_dates(view(s, d, "catalogue"), 20.0), "scene_date", "left_semi").orderBy("dt_utc"),
        f"{CAT}{OVER_SQL} SELECT * FROM over WHERE scene_date IN (SELECT scene_date FROM catalogue WHERE product_type = 'S2MSI2A' AND coalesce(cloud_cover, 100) <= 20)",
    ),
    "eval_dates_anti": (
        lambda s, d: quality.dates_without(scl(s, d), quality.scene_quality(scl(s, d)).where("bad_fraction <= 0.05")),
        f"{SCL}{QUAL} SELECT scene_date FROM qual WHERE nbad / total > 0.05",
    ),
    "scene_map_join": (
        lambda s, d: with_clean_map(quality.with_map)(s, d).select("scene_date", "y", "x", "scl", F.col("cls").cast("int").alias("cls")),
        f"{SCL}{MAP} SELECT scene_date, y, x, scl, cls FROM scl_obs JOIN refmap USING (y, x)",
    ),
    "dataset_assemble": (lambda s, d: r6(index(s, d), "height_m", "cloud_pct"), f"{INDEX_SQL} SELECT scene_date, dt_utc, round(height_m, 6) AS height_m, round(cloud_pct, 6) AS cloud_pct, coverage_pct FROM idx"),
    "coverage_map_back": (
        lambda s, d: bands.coverage_map_back(
            view(s, d, "rgb_obs").select("scene_date").distinct().withColumn("coverage_pct", F.when(F.month("scene_date") == 1, 12.5)),
            bands.tile_coverage(view(s, d, "rgb_obs").where(F.month("scene_date") != 2)),
        ),
        f"{RGB}{COVER} SELECT scene_date, CASE month(scene_date) WHEN 1 THEN 12.5::DOUBLE WHEN 2 THEN NULL ELSE coverage_pct END AS coverage_pct FROM cover",
    ),
    "scl_scene_quality": (
        q_scl_quality,
        f"""{SCL}{QUAL}, h AS (SELECT scene_date, string_agg(scl || ':' || n, ',' ORDER BY scl) AS class_counts FROM (SELECT scene_date, scl, count(*) AS n FROM scl_obs GROUP BY 1, 2) GROUP BY 1)
SELECT scene_date, total AS total_pixels, nbad AS bad_pixels, class_counts, round(nbad / total, 6) AS bad_fraction, round(nbad / total * 100, 6) AS bad_pct FROM qual JOIN h USING (scene_date)""",
    ),
    "transition_scene_quality": (
        lambda s, d: r6(with_clean_map(quality.transition_quality)(s, d), "bad_fraction", "bad_pct"),
        f"{SCL}{SCORE} SELECT scene_date, t AS n_transition, tb AS n_bad, round(CASE WHEN t = 0 THEN 1 ELSE tb / t END, 6) AS bad_fraction, round(CASE WHEN t = 0 THEN 1 ELSE tb / t END * 100, 6) AS bad_pct FROM sums",
    ),
    "scene_cloud_score": (score, f"{SCL}{SCORE} SELECT * FROM score"),
    "transition_pct_by_date": (lambda s, d: r6(with_clean_map(quality.transition_pct)(s, d), "transition_pct"), f"{SCL}{SCORE} SELECT scene_date, round(tb / greatest(t, 1) * 100, 6) AS transition_pct FROM sums"),
    "pixel_votes": (
        lambda s, d: r6(refmap.pixel_votes(scl(s, d)), "p_water", "p_land"),
        f"""{SCL}, v AS (SELECT y, x, count(*) FILTER (scl = 6) AS water_votes, count(*) FILTER (scl IN (4, 5)) AS land_votes FROM scl_obs GROUP BY 1, 2)
SELECT *, round(water_votes / greatest(water_votes + land_votes, 1), 6) AS p_water, round(land_votes / greatest(water_votes + land_votes, 1), 6) AS p_land FROM v""",
    ),
    "reference_map_local": (
        q_local_map,
        f"""{SCL}, v AS (SELECT y, x, count(*) FILTER (scl = 6) AS w, count(*) FILTER (scl IN (4, 5)) AS l FROM scl_obs GROUP BY 1, 2),
k AS (SELECT *, w / greatest(w + l, 1) AS p FROM v), kk AS (SELECT *, CASE WHEN w = 0 THEN 2 WHEN l = 0 THEN 1 ELSE 0 END AS kind FROM k),
n1 AS (SELECT DISTINCT a.y, a.x FROM kk a JOIN kk b ON b.kind = 1 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9),
n2 AS (SELECT DISTINCT a.y, a.x FROM kk a JOIN kk b ON b.kind = 2 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9)
SELECT kk.y, kk.x, CASE WHEN n1.y IS NOT NULL AND n2.y IS NOT NULL THEN 0 ELSE kind END AS cls, w AS water_votes, l AS land_votes, round(p, 6) AS p_water, round(1 - p, 6) AS p_land
FROM kk LEFT JOIN n1 ON n1.y = kk.y AND n1.x = kk.x LEFT JOIN n2 ON n2.y = kk.y AND n2.x = kk.x""",
    ),
    "reference_map_clean": (q_clean_map, f"{SCL}{MAP} SELECT y, x, cls, w AS water_votes, l AS land_votes, round(pw, 6) AS p_water, round(pl, 6) AS p_land FROM refmap"),
    "water_frequency": (
        lambda s, d: r6(freq(s, d), "water_freq"),
        f"""{SCL}, v AS (SELECT y, x, count(*) FILTER (scl = 6) AS w, count(*) FILTER (scl IN (4, 5, 6)) AS clear_votes FROM scl_obs GROUP BY 1, 2)
SELECT y, x, clear_votes, CASE WHEN clear_votes >= 8 THEN round(w / clear_votes, 6) END AS water_freq FROM v""",
    ),
    "daily_composite": (
        lambda s, d: r6(refmap.daily_composite(scl(s, d).withColumn("scene_date", F.date_trunc("YEAR", "scene_date").cast("date")), "scl"), "scl"),
        f"{SCL} SELECT CAST(date_trunc('year', scene_date) AS DATE) AS scene_date, y, x, round(avg(scl), 6) AS scl FROM scl_obs GROUP BY 1, 2, 3",
    ),
    "percentile_stretch_band": (
        lambda s, d: r6(bands.stretch_bands(view(s, d, "rgb_obs")), "b04", "b03", "b02"),
        f"""{RGB}, ends AS (SELECT scene_date, {", ".join(f"quantile_cont({b}, [0.02, 0.98]) FILTER ({b} > 0) AS p_{b}" for b in ("b04", "b03", "b02"))} FROM rgb_obs GROUP BY 1)
SELECT scene_date, y, x, {", ".join(f"round({_STRETCH.format(b=b).replace('p[', f'p_{b}[')}, 6) AS {b}" for b in ("b04", "b03", "b02"))} FROM rgb_obs JOIN ends USING (scene_date)""",
    ),
    "percentile_stretch_rgb": (
        lambda s, d: r6(bands.stretch_joint(view(s, d, "rgb_obs")), "b04", "b03", "b02"),
        f"{RGB}{_JOINT} SELECT scene_date, y, x, {', '.join(f'round({b}, 6) AS {b}' for b in ('b04', 'b03', 'b02'))} FROM st",
    ),
    "tile_coverage": (lambda s, d: bands.tile_coverage(view(s, d, "rgb_obs")), f"{RGB}{COVER} SELECT * FROM cover"),
    "recovery_gain": (
        lambda s, d: r6(quality.recovery_gain(quality.classify_dates(score(s, d))), "pct_initial", "pct_final", "gain_relative_pct"),
        f"""{SCL}{SCORE}, k AS (SELECT count(*) FILTER (status = 'reference') AS a, count(*) FILTER (status = 'recovered') AS r, count(*) AS n FROM classed)
SELECT a AS n_initial_valid, r AS n_recovered, a + r AS n_final_valid, n AS n_total_dates, round(100 * a / n, 6) AS pct_initial, round(100 * (a + r) / n, 6) AS pct_final,
CASE WHEN a = 0 THEN 0 ELSE round(100 * r / a, 6) END AS gain_relative_pct, r AS gain_absolute FROM k""",
    ),
    "map_class_counts": (
        lambda s, d: refmap.class_counts(clean_map(s, d)).select(F.col("cls").cast("int").alias("cls"), "n"),
        f"{SCL}{MAP} SELECT cls, count(*) AS n FROM refmap GROUP BY 1",
    ),
    "overpass_mean_hour": (
        lambda s, d: overpass(s, d).agg(F.round(F.avg(decimal_hour(F.col("dt_utc"))), 6).alias("mean_hour")),
        f"{CAT}{OVER_SQL} SELECT round(avg(hour(dt_utc) + minute(dt_utc) / 60 + second(dt_utc) / 3600), 6) AS mean_hour FROM over",
    ),
    "dates_per_year": (
        lambda s, d: dataset.dates_per_year(quality.filter_by_quality(scl(s, d)).where("status = 'valid'"), 1994, 2003),
        f"{SCL}{QUAL} SELECT CAST(k.y AS INT) AS year, count(q.scene_date) AS n FROM range(1994, 2004) k(y) LEFT JOIN (SELECT * FROM qual WHERE nbad / total <= 0.2) q ON year(q.scene_date) = k.y GROUP BY 1",
    ),
    "first_per_day": (
        lambda s, d: view(s, d, "catalogue").groupBy("scene_date").agg(F.min("seq").alias("seq"), F.min_by("dt_utc", "seq").alias("dt_utc")),
        f"{CAT} SELECT scene_date, min(seq) AS seq, arg_min(dt_utc, seq) AS dt_utc FROM catalogue GROUP BY 1",
    ),
    "sort_by_date": (lambda s, d: overpass(s, d).orderBy("scene_date"), f"{CAT}{OVER_SQL} SELECT * FROM over ORDER BY 1"),
    "head_n": (lambda s, d: index(s, d).select("scene_date", "dt_utc").orderBy("scene_date").limit(10), f"{INDEX_SQL} SELECT scene_date, dt_utc FROM idx ORDER BY 1 LIMIT 10"),
    "first_last": (
        lambda s, d: overpass(s, d).agg(F.min("scene_date").alias("first_date"), F.max("scene_date").alias("last_date"), F.max_by("dt_utc", "scene_date").alias("last_dt")),
        f"{CAT}{OVER_SQL} SELECT min(scene_date) AS first_date, max(scene_date) AS last_date, arg_max(dt_utc, scene_date) AS last_dt FROM over",
    ),
    "except_dates": (
        lambda s, d: scl(s, d).select("scene_date").distinct().exceptAll(quality.filter_by_quality(scl(s, d)).where("status = 'valid'").select("scene_date")),
        f"{SCL}{QUAL} SELECT scene_date FROM qual EXCEPT SELECT scene_date FROM qual WHERE nbad / total <= 0.2",
    ),
}
