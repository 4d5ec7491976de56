"""Tide and sampling-metric queries with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrackline.operators import metrics, tides
from wrackline.sources.fixtures import view, with_views

from .scenes import OVER_SQL, overpass, r6

REF = with_views("tide_reference", "tide_samples")
OBS = with_views("observed", "predicted")
ZOS = with_views("zos")
EPOCH = "TIMESTAMP '2000-01-01'"
TIDE = "sum(amp_m * cos(radians((speed_deg_h * (date_diff('second', TIMESTAMP '2000-01-01', {ts}) / 3600)) % 360 - phase_deg)))"


def samples(s, d):
    return view(s, d, "tide_samples")


def reference(s, d):
    return view(s, d, "tide_reference")


def compared(s, d):
    """Observed and predicted heights side by side."""
    return view(s, d, "observed").withColumnRenamed("height_m", "observed_height_m").join(view(s, d, "predicted"), "datetime")


def nodes(s, d):
    """Grid nodes that have a value at the first hour."""
    return view(s, d, "zos").where("hour_no = 0 AND zos IS NOT NULL").select(F.col("lat_i").cast("double").alias("lat"), F.col("lon_i").cast("double").alias("lon")).distinct()


def targets(s, d):
    z = view(s, d, "zos").select("lat_i", "lon_i").distinct()
    return z.select(F.concat_ws(":", "lat_i", "lon_i").alias("target"), (F.col("lat_i") + 0.3).alias("lat"), (F.col("lon_i") - 0.2).alias("lon"))


def series(s, d):
    return view(s, d, "zos").select(F.concat_ws(":", F.col("lat_i").cast("double"), F.col("lon_i").cast("double")).alias("node"), F.col("hour_no").cast("double").alias("t"), F.col("zos").alias("z"))


def wanted(s, d):
    return series(s, d).select("node", (F.col("t") + 0.4).alias("t"))


def q_gridded(s, d):
    """Heights at the nearest wet node of each target."""
    near = tides.nearest_point(targets(s, d), nodes(s, d), 2.0).select("target", F.concat_ws(":", "node_lat", "node_lon").alias("node"))
    times = near.join(wanted(s, d), "node")
    found = tides.interpolate(times.select("node", "t").distinct(), series(s, d))
    return r6(times.join(found, ["node", "t"]).select("target", "t", "height_m"), "t", "height_m")


def q_for_scenes(s, d):
    """Tide at each overpass by two models: all constituents, and the principal one."""
    over = overpass(s, d).select(F.col("dt_utc").alias("ts"))
    waves = view(s, d, "constituents")
    full = tides.predict(over, waves).withColumn("model", F.lit("harmonic"))
    m2 = tides.predict(over, waves.where("constituent = 'M2'")).withColumn("model", F.lit("principal"))
    return r6(full.unionByName(m2), "height_m")


def q_points(s, d):
    sites = targets(s, d).select(F.col("target").alias("site"), "lat", "lon")
    return r6(tides.point_grid(sites, 0.2, 0.1), "lat", "lon")


def windows(s, d):
    last = reference(s, d).agg(F.max("ts").cast("date").alias("last"))
    names = [("todo", 3650), ("ultimos_20_dias", 20), ("ultimos_10_dias", 10), ("ultimos_5_dias", 5)]
    return last.select(F.inline(F.array(*[F.struct(F.lit(n).alias("window"), F.date_sub("last", k).alias("start")) for n, k in names])))


def dated(s, d):
    return samples(s, d).withColumn("scene_date", F.to_date("ts"))


WIN = """, w AS (SELECT unnest(['todo', 'ultimos_20_dias', 'ultimos_10_dias', 'ultimos_5_dias']) AS "window", unnest([3650, 20, 10, 5]) AS k),
ws AS (SELECT "window", (SELECT CAST(max(ts) AS DATE) FROM tide_reference) - CAST(k AS INT) AS start FROM w)"""


def bin_sql(n: int) -> str:
    a, b = "CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END", "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END"
    return f"CASE WHEN v >= {a} AND v <= {b} THEN least(floor((v - ({a})) / ((({b}) - ({a})) / {n})), {n - 1}) END"


def families(samp: str, bins: int = 20) -> str:
    """CTEs of all metric families over samp (g, o, v); o is the reference's model."""
    return f""", samp AS ({samp}), ref AS (SELECT model AS o, height_m AS v FROM tide_reference),
rr AS (SELECT o, min(v) AS lo, max(v) AS hi FROM ref GROUP BY 1),
sr AS (SELECT g, any_value(o) AS o, min(v) AS smin, max(v) AS smax, count(*) AS n FROM samp GROUP BY 1),
cob AS (SELECT g, smin AS min_valido, smax AS max_valido, lo AS min_total, hi AS max_total, smax - smin AS rango_valido, hi - lo AS rango_total,
  CASE WHEN hi > lo THEN (smax - smin) / (hi - lo) ELSE 0 END AS cobertura FROM sr JOIN rr USING (o)),
rk AS (SELECT g, o, v, row_number() OVER (PARTITION BY g ORDER BY v) AS r FROM samp),
ks AS (SELECT g, max(n) AS n, max(greatest(r / n - u, u - (r - 1) / n)) AS d FROM (
  SELECT rk.g, r, n, least(1, greatest(0, (v - lo) / (hi - lo))) AS u FROM rk JOIN sr USING (g) JOIN rr ON rr.o = rk.o) GROUP BY 1),
bn AS (SELECT g, bin, count(*) AS n FROM (SELECT g, {bin_sql(bins)} AS bin FROM samp JOIN rr USING (o)) WHERE bin IS NOT NULL GROUP BY 1, 2),
ent AS (SELECT g, -sum(n / t * log2(n / t)) AS entropia, count(*) AS occ FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS t FROM bn) GROUP BY 1),
gp AS (SELECT g, gap FROM (SELECT g, v - lag(v) OVER (PARTITION BY g ORDER BY v) AS gap FROM samp) WHERE gap IS NOT NULL),
dis AS (SELECT g, avg(gap) AS m, var_samp(gap) AS s2, var_samp(gap) / nullif(avg(gap), 0) AS vmr FROM gp GROUP BY 1),
mo AS (SELECT g, avg(gap) AS mu, stddev_pop(gap) AS sp FROM gp GROUP BY 1),
gs AS (SELECT g, count(*) + 1 AS n_muestras, count(*) AS n_gaps, avg(gap) AS media, median(gap) AS mediana, stddev_samp(gap) AS std, min(gap) AS mn, max(gap) AS mx,
  quantile_cont(gap, 0.25) AS p25, quantile_cont(gap, 0.75) AS p75, avg(pow((gap - mu) / sp, 3)) AS skewness, avg(pow((gap - mu) / sp, 4)) - 3 AS kurtosis FROM gp JOIN mo USING (g) GROUP BY 1),
lv AS (SELECT g, lag(v) OVER (PARTITION BY g ORDER BY v) AS lo, v AS hi FROM (SELECT DISTINCT g, v FROM samp)),
vs AS (SELECT g, avg(hi - lo) AS vsr, median(hi - lo) AS med, min(hi - lo) AS mn, max(hi - lo) AS mx, arg_max(lo, hi - lo) AS a, arg_max(hi, hi - lo) AS b, count(*) + 1 AS levels
  FROM lv WHERE lo IS NOT NULL GROUP BY 1),
q10 AS (SELECT g, bin, count(*) AS n FROM (SELECT g, {bin_sql(10)} AS bin FROM samp JOIN rr USING (o)) WHERE bin IS NOT NULL GROUP BY 1, 2),
rep AS (SELECT g, list(coalesce(n, 0) ORDER BY i) AS dist, list(CAST(i AS INT) ORDER BY i) FILTER (n IS NULL) AS empty, count(n) AS held
  FROM (SELECT g, i, n FROM sr CROSS JOIN range(10) k(i) LEFT JOIN q10 USING (g) WHERE q10.bin = k.i OR q10.bin IS NULL) GROUP BY 1)"""


def rep_fixed(text: str) -> str:
    """The bins of a group with their counts, empty ones included."""
    a = text.index("rep AS (")
    return text[:a] + """rep AS (SELECT f.g, list(coalesce(q.n, 0) ORDER BY f.i) AS dist, coalesce(list(CAST(f.i AS INT) ORDER BY f.i) FILTER (q.n IS NULL), []) AS empty, count(q.n) AS held
  FROM (SELECT g, i FROM sr, range(10) k(i)) f LEFT JOIN q10 q ON q.g = f.g AND q.bin = f.i GROUP BY 1)"""


BASE = REF + rep_fixed(families("SELECT model AS g, model AS o, height_m AS v FROM tide_samples"))
WINDOWED = REF + WIN + rep_fixed(families("""SELECT "window" || '|' || model AS g, model AS o, height_m AS v FROM tide_samples JOIN ws ON CAST(ts AS DATE) >= start"""))
# The p-value of the far tail, 2 exp(-(2.000071 + 0.331 / sqrt(n) + 1.409 / n) n d^2); the distances at sf0.01 lie there, those of windows of few samples don't.
KS_P = "2 * exp(-(2.000071 + 0.331 / sqrt(ks.n) + 1.409 / ks.n) * ks.n * d * d)"
KS_TEXT = f"CASE WHEN {KS_P} > 0.1 THEN 'Altamente uniforme' WHEN {KS_P} > 0.05 THEN 'Razonablemente uniforme' WHEN {KS_P} > 0.01 THEN 'Moderadamente no uniforme' ELSE 'Altamente no uniforme' END"
# The p-value's own threshold: at 5 % the distance times the root of n (with Stephens' correction) is 1.358.
VERDICT = """, ver AS (SELECT g, cobertura >= 0.85 AS cobertura_suficiente, d * (sqrt(ks.n) + 0.12 + 0.11 / sqrt(ks.n)) < 1.358 AS uniforme_ks, entropia / log2(20) >= 0.7 AS entropia_alta,
  coalesce(vmr <= 1.2, false) AS no_agrupado, coalesce(vsr <= 0.25, false) AS vsr_adecuado, held / 10 >= 0.8 AS representativo
  FROM cob JOIN ks USING (g) JOIN ent USING (g) JOIN dis USING (g) JOIN vs USING (g) JOIN rep USING (g)),
vn AS (SELECT *, cobertura_suficiente::INT + uniforme_ks::INT + entropia_alta::INT + no_agrupado::INT + vsr_adecuado::INT + representativo::INT AS k FROM ver),
vg AS (SELECT *, CASE WHEN k = 6 THEN 'Excelente' WHEN k >= 4 THEN 'Buena' WHEN k = 3 THEN 'Aceptable' ELSE 'Pobre' END AS grade, cobertura_suficiente AND vsr_adecuado AND representativo AS apta FROM vn)"""
PATRON = "CASE WHEN m IS NULL THEN 'Indefinido' WHEN vmr < 0.8 THEN 'Regular (uniforme)' WHEN vmr <= 1.2 THEN 'Aleatorio (Poisson)' ELSE 'Agrupado (clustered)' END"
CALIDAD = """CASE WHEN vsr <= 0.1 THEN 'Alta (excelente para topografía detallada)' WHEN vsr <= 0.2 THEN 'Buena (adecuada para la mayoría de análisis)'
WHEN vsr <= 0.3 THEN 'Moderada (puede perder algunos detalles)' ELSE 'Baja (resolución insuficiente para detalles finos)' END"""
CRITERIA = ["cobertura_suficiente", "uniforme_ks", "entropia_alta", "no_agrupado", "vsr_adecuado", "representativo"]


def full(s, d):
    return metrics.full_metrics(samples(s, d), reference(s, d))


def q_full(s, d):
    """Every field of every family, a column each."""
    m = full(s, d)
    fields = [(f.name, c.name, c.dataType.typeName()) for f in m.schema.fields[1:] for c in f.dataType.fields]
    columns = []
    for family, name, kind in fields:
        value = F.col(f"{family}.{name}")
        if kind == "struct":
            columns += [F.round(value[end], 6).alias(f"{family}_{name}_{end}") for end in ("lo", "hi")]
        else:
            columns.append((F.round(value, 6) if kind == "double" else value).alias(f"{family}_{name}"))
    return m.select("model", *columns)


def q_verdict(s, d):
    v = metrics.distribution_verdict(full(s, d))
    return v.select("model", *CRITERIA, "n_criterios_cumplidos", "calidad_global", "apta", "recomendaciones")


def q_table(s, d):
    return metrics.metric_table(metrics.distribution_verdict(full(s, d)))


def q_windows(s, d):
    w = metrics.window_metrics(dated(s, d), reference(s, d), windows(s, d))
    six = {"cobertura": "cobertura.cobertura", "vsr": "vsr.vsr", "representatividad": "representatividad.representatividad", "entropia": "entropia.entropia", "vmr": "dispersion.vmr"}
    return metrics.metric_table(w, "window", "model", *[F.round(c, 6).alias(n) for n, c in six.items()], "apta")


def q_vsr(s, d):
    v = metrics.vertical_sampling(samples(s, d))
    v = v.select("model", "vsr", "vsr_mediana", "vsr_min", "vsr_max", "max_gap", F.col("max_gap_ubicacion.lo").alias("gap_lo"), F.col("max_gap_ubicacion.hi").alias("gap_hi"), "n_niveles", "calidad_vsr")
    return r6(v, "vsr", "vsr_mediana", "vsr_min", "vsr_max", "max_gap", "gap_lo", "gap_hi")


_ERR = """SELECT '{c}' AS model, count(*) AS n_observed, count(h) AS n_compared, round(avg(abs(h - o)), 6) AS mae, round(sqrt(avg((h - o) * (h - o))), 6) AS rmse, round(min(abs(h - o)), 6) AS min_abs,
round(max(abs(h - o)), 6) AS max_abs FROM (SELECT {e} AS h, height_m AS o FROM observed JOIN predicted USING (datetime))"""
_D2 = "pow(n.lat - t.lat, 2) + pow(n.lon - t.lon, 2)"
NEAR = """, nodes AS (SELECT DISTINCT lat_i::DOUBLE AS lat, lon_i::DOUBLE AS lon FROM zos WHERE hour_no = 0 AND zos IS NOT NULL),
targets AS (SELECT DISTINCT lat_i || ':' || lon_i AS target, lat_i + 0.3::DOUBLE AS lat, lon_i - 0.2::DOUBLE AS lon FROM zos)"""
CUBIC = """, ser AS (SELECT lat_i::DOUBLE || ':' || lon_i::DOUBLE AS node, hour_no AS t, zos AS z FROM zos),
nb AS (SELECT node, t, z, lag(z) OVER w AS z0, lead(z) OVER w AS z2, lead(z, 2) OVER w AS z3, t - lag(t) OVER w AS d0, lead(t) OVER w - t AS d2, lead(t, 2) OVER w - t AS d3 FROM ser
  WINDOW w AS (PARTITION BY node ORDER BY t)),
cub AS (SELECT node, t + 0.4::DOUBLE AS t, z0 * (0.4::DOUBLE * -0.6 * -1.6) / -6 + z * (1.4::DOUBLE * -0.6 * -1.6) / 2 + z2 * (1.4::DOUBLE * 0.4 * -1.6) / -2 + z3 * (1.4::DOUBLE * 0.4 * -0.6) / 6 AS h
  FROM nb WHERE d0 = 1 AND d2 = 1 AND d3 = 2 AND z0 + z + z2 + z3 IS NOT NULL)"""

#: The whole system of slopes solved a knot at a time, forwards and back.
SPLINE = ZOS.replace("WITH ", "WITH RECURSIVE ", 1) + """, ser AS (SELECT lat_i::DOUBLE || ':' || lon_i::DOUBLE AS node, hour_no::DOUBLE AS t, zos AS z FROM zos),
kn AS (SELECT node, t AS x, z AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY node) AS n, lead(t) OVER w AS x1, lead(z) OVER w AS y1 FROM ser WHERE z IS NOT NULL WINDOW w AS (PARTITION BY node ORDER BY t)),
hd AS (SELECT *, x1 - x AS h, (y1 - y) / (x1 - x) AS d FROM kn),
nb AS (SELECT *, lag(h) OVER w AS h0, lag(d) OVER w AS d0, lag(h, 2) OVER w AS hh, lag(d, 2) OVER w AS dd, lead(h) OVER w AS h2, lead(d) OVER w AS d2 FROM hd WINDOW w AS (PARTITION BY node ORDER BY i)),
sy AS MATERIALIZED (SELECT node, i, n, x, y, x1, y1, h, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN h0 + hh ELSE h END AS a, CASE WHEN i = 0 THEN h2 WHEN i = n - 1 THEN hh ELSE 2 * (h0 + h) END AS b,
  CASE WHEN i = 0 THEN h + h2 WHEN i = n - 1 THEN 0 ELSE h0 END AS c, CASE WHEN i = 0 THEN ((h + 2 * (h + h2)) * h2 * d + h * h * d2) / (h + h2)
  WHEN i = n - 1 THEN (h0 * h0 * dd + (2 * (h0 + hh) + h0) * hh * d0) / (h0 + hh) ELSE 3 * (h * d0 + h0 * d) END AS r FROM nb WHERE n > 3),
fw AS (SELECT node, i, c / b AS cp, r / b AS dp FROM sy WHERE i = 0 UNION ALL
  SELECT s.node, s.i, s.c / (s.b - s.a * f.cp), (s.r - s.a * f.dp) / (s.b - s.a * f.cp) FROM fw f JOIN sy s ON s.node = f.node AND s.i = f.i + 1),
fm AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT fm.node, fm.i, dp AS s FROM fm JOIN sy USING (node, i) WHERE i = n - 1 UNION ALL SELECT f.node, f.i, f.dp - f.cp * b.s FROM bw b JOIN fm f ON f.node = b.node AND f.i = b.i - 1),
sl AS MATERIALIZED (SELECT * FROM bw),
pc AS (SELECT sy.*, p.s, q.s AS s1, (y1 - y) / h AS d FROM sy JOIN sl p USING (node, i) JOIN sl q ON q.node = sy.node AND q.i = sy.i + 1),
wa AS (SELECT node, t + 0.4::DOUBLE AS t FROM ser)
SELECT node, round(t, 6) AS t, round(y + (t - x) * (s + (t - x) * ((3 * d - 2 * s - s1) / h + (t - x) * (s + s1 - 2 * d) / (h * h))), 6) AS height_m
FROM wa JOIN pc USING (node) WHERE t >= x AND t < x1"""

TABLE = f"""printf('%.1f', cobertura * 100) AS cobertura_pct, printf('%.2f', rango_valido) AS rango_m, printf('%.4f', vsr) AS vsr_m, levels AS niveles, printf('%.1f', held * 10.0::DOUBLE) AS repr_pct,
printf('%.4f', {KS_P}) AS ks_pval, printf('%.3f', entropia / log2(20)) AS entropia_norm, printf('%.3f', vmr) AS vmr_ratio,
CASE WHEN uniforme_ks THEN '✓' ELSE '✗' END AS uniforme, split_part({PATRON}, ' ', 1) AS patron_tipo, grade AS calidad, CASE WHEN apta THEN '✓' ELSE '✗' END AS es_apta, k || '/6' AS criterios"""
_ROUND = {
    "cobertura": {c: c for c in ("min_valido", "max_valido", "min_total", "max_total", "rango_valido", "rango_total", "cobertura")} | {"cobertura_pct": "cobertura * 100"},
    "uniformidad_ks": {"ks_statistic": "d", "ks_pvalue": KS_P},
    "entropia": {"entropia": "entropia", "entropia_max": "log2(20)", "entropia_norm": "entropia / log2(20)"},
    "dispersion": {"vmr": "vmr", "media_gaps": "m", "varianza_gaps": "s2"},
    "gaps": {"media": "media", "mediana": "mediana", "std": "std", "cv": "std / media", "min": "gs.mn", "max": "gs.mx", "p25": "p25", "p75": "p75", "iqr": "p75 - p25", "skewness": "skewness", "kurtosis": "kurtosis"},
    "vsr": {"vsr": "vsr", "vsr_mediana": "med", "vsr_min": "vs.mn", "vsr_max": "vs.mx", "max_gap": "vs.mx", "max_gap_ubicacion_lo": "a", "max_gap_ubicacion_hi": "b"},
    "representatividad": {"representatividad": "held / 10", "representatividad_pct": "held * 10.0::DOUBLE"},
}
_PLAIN = {
    "uniformidad_ks": {"n": "ks.n", "uniforme": "d * (sqrt(ks.n) + 0.12 + 0.11 / sqrt(ks.n)) < 1.358", "interpretacion": KS_TEXT},
    "entropia": {"n_bins": "20", "n_bins_ocupados": "occ", "n_bins_vacios": "20 - occ"},
    "dispersion": {"patron": PATRON},
    "gaps": {"n_muestras": "n_muestras", "n_gaps": "n_gaps"},
    "vsr": {"n_niveles": "levels", "calidad_vsr": CALIDAD},
    "representatividad": {"quantiles_cubiertos": "CAST(held AS INT)", "quantiles_totales": "10", "quantiles_vacios": "empty", "distribucion_muestras": "dist"},
}
FULL_SQL = (
    f"{BASE} SELECT g AS model, "
    + ", ".join([f"round({e}, 6) AS {f}_{c}" for f, cs in _ROUND.items() for c, e in cs.items()] + [f"{e} AS {f}_{c}" for f, cs in _PLAIN.items() for c, e in cs.items()])
    + " FROM cob JOIN ks USING (g) JOIN ent USING (g) JOIN dis USING (g) JOIN gs USING (g) JOIN vs USING (g) JOIN rep USING (g)"
)

QUERIES = {
    "normalise_by_reference_mean": (
        lambda s, d: r6(tides.normalise_by_reference_mean(samples(s, d), reference(s, d)), "height_norm_m"),
        f"{REF} SELECT s.model, s.ts, round(s.height_m - m, 6) AS height_norm_m FROM tide_samples s JOIN (SELECT model, avg(height_m) AS m FROM tide_reference GROUP BY 1) USING (model)",
    ),
    "anomaly_join": (
        lambda s, d: tides.anomaly_join(view(s, d, "observed"), view(s, d, "predicted").withColumnRenamed("got410_height_m", "predicted_height_m")).withColumns({c: F.round(c, 9) for c in ("height_m", "predicted_height_m", "anomaly")}),
        f"{OBS} SELECT datetime, round(height_m, 9) AS height_m, round(got410_height_m, 9) AS predicted_height_m, round(height_m - got410_height_m, 9) AS anomaly FROM observed JOIN predicted USING (datetime)",
    ),
    "window_range_join": (
        lambda s, d: metrics.in_windows(dated(s, d), windows(s, d)).groupBy("window", "model").agg(F.count("*").alias("n"), F.min("scene_date").alias("first_date")),
        f"""{REF}{WIN} SELECT "window", model, count(*) AS n, min(CAST(ts AS DATE)) AS first_date FROM tide_samples JOIN ws ON CAST(ts AS DATE) >= start GROUP BY 1, 2""",
    ),
    "nearest_valid_point": (
        lambda s, d: r6(tides.nearest_point(targets(s, d), nodes(s, d), 2.0), "d2"),
        f"""{ZOS}{NEAR} SELECT target, n.lat AS node_lat, n.lon AS node_lon, round({_D2}, 6) AS d2 FROM targets t JOIN nodes n ON abs(n.lat - t.lat) <= 2 AND abs(n.lon - t.lon) <= 2
QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_D2}, n.lat, n.lon) = 1""",
    ),
    "nearest_valid_probe": (
        lambda s, d: r6(tides.nearest_probe(targets(s, d), nodes(s, d), 3.0), "d2"),
        f"""{ZOS}{NEAR}, c AS (SELECT target, n.lat AS node_lat, n.lon AS node_lon, {_D2} AS d2, greatest(abs(n.lat - t.lat), abs(n.lon - t.lon)) AS far FROM targets t JOIN nodes n
  ON abs(n.lat - t.lat) <= 3 AND abs(n.lon - t.lon) <= 3), b AS (SELECT *, CASE WHEN far <= 0.2 THEN 0.2::DOUBLE WHEN far <= 0.5 THEN 0.5::DOUBLE WHEN far <= 1 THEN 1::DOUBLE ELSE 3::DOUBLE END AS box FROM c)
SELECT target, box, node_lat, node_lon, round(d2, 6) AS d2 FROM b QUALIFY row_number() OVER (PARTITION BY target ORDER BY box, d2, node_lat, node_lon) = 1""",
    ),
    "tide_interpolate": (
        lambda s, d: r6(tides.interpolate(wanted(s, d), series(s, d)), "t", "height_m"),
        f"{ZOS}{CUBIC} SELECT node, round(t, 6) AS t, round(h, 6) AS height_m FROM cub",
    ),
    "tide_interpolate_spline": (lambda s, d: r6(tides.interpolate_spline(wanted(s, d), series(s, d)), "t", "height_m"), SPLINE),
    "tide_summary": (
        lambda s, d: r6(tides.tide_summary(samples(s, d)), "min_m", "max_m", "mean_m", "median_m", "range_m"),
        f"""{REF} SELECT model, count(*) AS n, round(min(height_m), 6) AS min_m, round(max(height_m), 6) AS max_m, round(avg(height_m), 6) AS mean_m, round(median(height_m), 6) AS median_m,
round(max(height_m) - min(height_m), 6) AS range_m FROM tide_samples GROUP BY 1""",
    ),
    "tide_error_metrics": (
        lambda s, d: r6(tides.model_errors(compared(s, d)), "mae", "rmse", "min_abs", "max_abs"),
        f"{OBS} {_ERR.format(c='got410_height_m', e='got410_height_m')} UNION ALL {_ERR.format(c='cmems_height_m', e='cmems_height_m')}",
    ),
    "compare_models": (
        lambda s, d: r6(tides.model_errors(compared(s, d).withColumn("mean_height_m", (F.col("got410_height_m") + F.col("cmems_height_m")) / 2), ("got410_height_m", "cmems_height_m", "mean_height_m")), "mae", "rmse", "min_abs", "max_abs"),
        f"{OBS} {_ERR.format(c='got410_height_m', e='got410_height_m')} UNION ALL {_ERR.format(c='cmems_height_m', e='cmems_height_m')} UNION ALL {_ERR.format(c='mean_height_m', e='(got410_height_m + cmems_height_m) / 2')}",
    ),
    "range_coverage": (
        lambda s, d: r6(metrics.range_coverage(samples(s, d), reference(s, d)), "min_valido", "max_valido", "min_total", "max_total", "rango_valido", "rango_total", "cobertura", "cobertura_pct"),
        f"{BASE} SELECT g AS model, {', '.join(f'round({c}, 6) AS {c}' for c in ('min_valido', 'max_valido', 'min_total', 'max_total', 'rango_valido', 'rango_total', 'cobertura'))}, round(cobertura * 100, 6) AS cobertura_pct FROM cob",
    ),
    "uniformity_ks": (
        lambda s, d: r6(metrics.uniformity_ks(samples(s, d), reference(s, d)), "ks_statistic", "ks_pvalue"),
        f"{BASE} SELECT g AS model, n, round(d, 6) AS ks_statistic, round({KS_P}, 6) AS ks_pvalue, d * (sqrt(n) + 0.12 + 0.11 / sqrt(n)) < 1.358 AS uniforme, {KS_TEXT} AS interpretacion FROM ks",
    ),
    "shannon_entropy": (
        lambda s, d: r6(metrics.shannon_entropy(samples(s, d), reference(s, d), bins=30), "entropia", "entropia_max", "entropia_norm"),
        f"""{REF}{rep_fixed(families("SELECT model AS g, model AS o, height_m AS v FROM tide_samples", 30))} SELECT g AS model, round(entropia, 6) AS entropia, round(log2(30), 6) AS entropia_max,
round(entropia / log2(30), 6) AS entropia_norm, 30 AS n_bins, occ AS n_bins_ocupados, 30 - occ AS n_bins_vacios FROM ent""",
    ),
    "dispersion_vmr": (
        lambda s, d: r6(metrics.dispersion_vmr(samples(s, d)), "vmr", "media_gaps", "varianza_gaps"),
        f"{BASE} SELECT g AS model, round(vmr, 6) AS vmr, {PATRON} AS patron, round(m, 6) AS media_gaps, round(s2, 6) AS varianza_gaps FROM dis",
    ),
    "gap_statistics": (
        lambda s, d: r6(metrics.gap_statistics(samples(s, d)), "media", "mediana", "std", "cv", "min", "max", "p25", "p75", "iqr", "skewness", "kurtosis"),
        f"""{BASE} SELECT g AS model, n_muestras, n_gaps, round(media, 6) AS media, round(mediana, 6) AS mediana, round(std, 6) AS std, round(std / media, 6) AS cv, round(mn, 6) AS min, round(mx, 6) AS max,
round(p25, 6) AS p25, round(p75, 6) AS p75, round(p75 - p25, 6) AS iqr, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM gs""",
    ),
    "vertical_sampling": (
        q_vsr,
        f"""{BASE} SELECT g AS model, round(vsr, 6) AS vsr, round(med, 6) AS vsr_mediana, round(mn, 6) AS vsr_min, round(mx, 6) AS vsr_max, round(mx, 6) AS max_gap, round(a, 6) AS gap_lo, round(b, 6) AS gap_hi,
levels AS n_niveles, {CALIDAD} AS calidad_vsr FROM vs""",
    ),
    "representativeness": (
        lambda s, d: r6(metrics.representativeness(samples(s, d), reference(s, d)), "representatividad", "representatividad_pct"),
        f"{BASE} SELECT g AS model, round(held / 10, 6) AS representatividad, round(held * 10.0::DOUBLE, 6) AS representatividad_pct, CAST(held AS INT) AS quantiles_cubiertos, 10 AS quantiles_totales, empty AS quantiles_vacios, dist AS distribucion_muestras FROM rep",
    ),
    "full_metrics": (
        q_full,
        FULL_SQL,
    ),
    "distribution_verdict": (
        q_verdict,
        f"""{BASE}{VERDICT} SELECT g AS model, {", ".join(CRITERIA)}, k AS n_criterios_cumplidos, grade AS calidad_global, apta, list_filter([
  CASE WHEN NOT cobertura_suficiente THEN 'Cobertura insuficiente (' || printf('%.1f', cobertura * 100) || '%). Añadir imágenes en mareas extremas.' END,
  CASE WHEN NOT vsr_adecuado THEN 'VSR demasiado alta (' || printf('%.3f', vsr) || ' m). Aumentar el número de observaciones.' END,
  CASE WHEN NOT representativo THEN 'Baja representatividad (' || printf('%.1f', held * 10.0::DOUBLE) || '%). Añadir imágenes en quantiles [' || array_to_string(empty, ', ') || '].' END,
  CASE WHEN NOT uniforme_ks THEN 'Distribución no uniforme. Seleccionar imágenes más distribuidas en el rango mareal.' END,
  CASE WHEN NOT no_agrupado THEN 'Muestras agrupadas (VMR=' || printf('%.2f', vmr) || '). Distribuir observaciones más uniformemente.' END], lambda x: x IS NOT NULL) AS recomendaciones
FROM vg JOIN cob USING (g) JOIN vs USING (g) JOIN rep USING (g) JOIN dis USING (g)""",
    ),
    "model_metric_table": (
        q_table,
        f"""{BASE}{VERDICT} SELECT g AS model, n_muestras AS n_obs, {TABLE}
FROM vg JOIN gs USING (g) JOIN cob USING (g) JOIN vs USING (g) JOIN rep USING (g) JOIN dis USING (g) JOIN ent USING (g) JOIN ks USING (g)""",
    ),
    "window_metric_table": (
        q_windows,
        f"""{WINDOWED}{VERDICT} SELECT array_to_string(list_transform(string_split(split_part(g, '|', 1), '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS "window", split_part(g, '|', 2) AS model, n_muestras AS n_obs,
round(cobertura, 6) AS cobertura, round(vsr, 6) AS vsr, round(held / 10, 6) AS representatividad, round(entropia, 6) AS entropia, round(vmr, 6) AS vmr, apta, {TABLE}
FROM vg JOIN gs USING (g) JOIN cob USING (g) JOIN vs USING (g) JOIN rep USING (g) JOIN dis USING (g) JOIN ent USING (g) JOIN ks USING (g)""",
    ),
    "rank_sorted": (
        lambda s, d: r6(metrics.rank_sorted(samples(s, d)), "v"),
        f"{REF} SELECT model, round(height_m, 6) AS v, row_number() OVER (PARTITION BY model ORDER BY height_m) AS rank FROM tide_samples",
    ),
    "neighbour_gaps": (
        lambda s, d: r6(metrics.neighbour_gaps(samples(s, d)), "lo", "v", "gap"),
        f"""{REF}, k AS (SELECT model, lag(height_m) OVER (PARTITION BY model ORDER BY height_m) AS lo, height_m AS v FROM tide_samples)
SELECT model, round(lo, 6) AS lo, round(v, 6) AS v, round(v - lo, 6) AS gap FROM k WHERE lo IS NOT NULL""",
    ),
    "tide_point_grid": (
        q_points,
        f"{ZOS}{NEAR} SELECT target AS site, round(lat + i * 0.1::DOUBLE, 6) AS lat, round(lon + j * 0.1::DOUBLE, 6) AS lon FROM targets, range(-2, 3) a(i), range(-2, 3) b(j)",
    ),
    "tide_predict": (
        lambda s, d: r6(tides.predict(samples(s, d).select("ts").distinct(), view(s, d, "constituents")), "height_m"),
        f"{with_views('tide_samples', 'constituents')} SELECT ts, round({TIDE.format(ts='ts')}, 6) AS height_m FROM (SELECT DISTINCT ts FROM tide_samples), constituents GROUP BY ts",
    ),
    "tide_gridded": (
        q_gridded,
        f"""{ZOS}{NEAR}{CUBIC}, near AS (SELECT target, n.lat || ':' || n.lon AS node FROM targets t JOIN nodes n ON abs(n.lat - t.lat) <= 2 AND abs(n.lon - t.lon) <= 2
QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_D2}, n.lat, n.lon) = 1) SELECT target, round(t, 6) AS t, round(h, 6) AS height_m FROM near JOIN cub USING (node)""",
    ),
    "tide_for_scenes": (
        q_for_scenes,
        f"""{with_views("catalogue", "constituents")}{OVER_SQL} SELECT dt_utc AS ts, 'harmonic' AS model, round({TIDE.format(ts="dt_utc")}, 6) AS height_m FROM over, constituents GROUP BY dt_utc
UNION ALL SELECT dt_utc, 'principal', round({TIDE.format(ts="dt_utc")}, 6) FROM over, constituents WHERE constituent = 'M2' GROUP BY dt_utc""",
    ),
}
