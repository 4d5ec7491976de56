"""Tide operators: nearest wet nodes, harmonic synthesis, interpolation of gridded series, model errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.operators import splines
from wrackline.operators.nearest import nearest
from wrackline.operators.quantiles import selected

BOXES = (0.2, 0.5, 1.0)


def point_grid(sites: DataFrame, box: float, step: float) -> DataFrame:
    """Sampling points lat, lon at +- box around each site."""
    n = int(round(box / step))
    k = F.sequence(F.lit(-n), F.lit(n))
    rows = sites.select("site", "lat", "lon", F.explode(k).alias("i")).select("*", F.explode(k).alias("j"))
    return rows.select("site", (F.col("lat") + F.col("i") * step).alias("lat"), (F.col("lon") + F.col("j") * step).alias("lon"))


def nearest_point(targets: DataFrame, nodes: DataFrame, box: float) -> DataFrame:
    """The nearest valid node of each target within +- box degrees (plain degrees; least lat, then lon, among equals). Targets without one are left out."""
    return nearest(targets, nodes, [box]).select("target", "node_lat", "node_lon", "d2")


def nearest_probe(targets: DataFrame, nodes: DataFrame, box: float = 1.0, boxes: tuple = BOXES) -> DataFrame:
    """The same within the smallest of growing boxes that holds a valid node."""
    sizes = sorted({*boxes, box})
    size = F.element_at(F.array(*[F.lit(float(s)) for s in sizes]), F.col("box") + 1)
    return nearest(targets, nodes, sizes).select("target", size.alias("box"), "node_lat", "node_lon", "d2")


def predict(times: DataFrame, constituents: DataFrame, epoch: str = "2000-01-01 00:00:00", keys: tuple = ("ts",)) -> DataFrame:
    """Harmonic synthesis: the sum over constituents of f A cos(w t + V + u - phase) at each time.

    constituents: amp_m, speed_deg_h, phase_deg, perhaps node_factor (f) and argument_deg (V + u). If it has keys shared
    with times (a node), its waves are packed by key and joined; if not, the one set of waves is a scalar subquery of the plan.
    """
    hours = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit(epoch)), F.col("ts")) / 3600.0
    has = constituents.columns
    f = F.col("node_factor") if "node_factor" in has else F.lit(1.0)
    v = F.col("argument_deg") if "argument_deg" in has else F.lit(0.0)
    wave = F.struct((f * F.col("amp_m")).alias("a"), F.col("speed_deg_h").alias("w"), (v - F.col("phase_deg")).alias("p"))
    shared = [c for c in has if c in keys]
    if shared:
        rows = times.join(constituents.groupBy(*shared).agg(F.collect_list(wave).alias("waves")), shared)
    else:
        rows = times.withColumn("waves", constituents.agg(F.collect_list(wave)).scalar())
    height = F.aggregate("waves", F.lit(0.0), lambda acc, c: acc + c["a"] * F.cos(F.radians(F.pmod(c["w"] * hours, F.lit(360.0)) + c["p"])))
    return rows.withColumn("height_m", height).drop("waves")


def _lagrange(t: Column, points: Column) -> Column:
    """Cubic through four (t, z) points, as an expression."""
    out = F.lit(0.0)
    for i in range(4):
        term = points[i]["z"]
        for j in range(4):
            if i != j:
                term = term * (t - points[j]["t"]) / (points[i]["t"] - points[j]["t"])
        out = out + term
    return out


def interpolate(times: DataFrame, series: DataFrame, reach: float = 2.0) -> DataFrame:
    """Heights at times (hours) from an hourly series by the cubic through its four nearest points within +- reach.

    times: node, t. series: node, t, z. Each time is joined on node and hour with the five hours around it, so nothing but
    neighbours meets. Times with fewer than four points in reach have none and are left out.
    """
    around = times.select("node", "t", F.floor("t").cast("int").alias("base")).select("*", F.explode(F.sequence(F.col("base") - 2, F.col("base") + 3)).alias("hour"))
    points = series.where("z IS NOT NULL").select("node", F.floor("t").cast("int").alias("hour"), F.col("t").alias("pt"), "z")
    rows = around.join(points, ["node", "hour"]).where(F.abs(F.col("pt") - F.col("t")) <= reach)
    four = rows.groupBy("node", "t").agg(F.array_sort(F.collect_list(F.struct(F.abs(F.col("pt") - F.col("t")).alias("d"), F.col("pt").alias("t"), "z"))).alias("p"))
    return four.where(F.size("p") >= 4).select("node", "t", _lagrange(F.col("t"), F.slice("p", 1, 4)).alias("height_m"))


def interpolate_spline(times: DataFrame, series: DataFrame, block: int = splines.BLOCK, run: int = splines.RUN) -> DataFrame:
    """The same by one not-a-knot spline over each whole series, as a batch of times has it; see splines.spline."""
    return splines.spline(times, series, block, run)


def tide_summary(heights: DataFrame, by: str = "model") -> DataFrame:
    """Count, extremes, mean, exact median and range of each group's heights."""
    h = F.col("height_m")
    rest = heights.groupBy(by).agg(F.count(h).alias("n"), F.min(h).alias("min_m"), F.max(h).alias("max_m"), F.avg(h).alias("mean_m"), (F.max(h) - F.min(h)).alias("range_m"))
    middle = selected(heights, [by], "height_m", {"median_m": 0.5}).withColumnRenamed(by, "key")
    return rest.join(middle, F.col(by).eqNullSafe(F.col("key")), "left").select(by, "n", "min_m", "max_m", "mean_m", "median_m", "range_m")


def anomaly_join(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """observed and predicted heights at the same time, and their difference. Many rows of one time all meet; NULL times meet none."""
    p = predicted.select("datetime", "predicted_height_m")
    return observed.select("datetime", "height_m").join(p, "datetime").withColumn("anomaly", F.col("height_m") - F.col("predicted_height_m"))


def model_errors(rows: DataFrame, models: tuple = ("got410_height_m", "cmems_height_m"), observed: str = "observed_height_m") -> DataFrame:
    """MAE, RMSE, least and greatest absolute error of each model column over rows with an observation.

    n_observed counts the rows observed, n_compared those where the model has a value too.
    """
    e = F.abs(F.col("h") - F.col(observed))
    long = rows.where(F.col(observed).isNotNull()).unpivot(observed, list(models), "model", "h")
    return long.groupBy("model").agg(F.count("*").alias("n_observed"), F.count("h").alias("n_compared"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.min(e).alias("min_abs"), F.max(e).alias("max_abs"))


def normalise_by_reference_mean(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Heights less the mean of the model's reference series."""
    mean = reference.groupBy("model").agg(F.avg("height_m").alias("mean_m"))
    return samples.join(mean, "model").select("model", "ts", (F.col("height_m") - F.col("mean_m")).alias("height_norm_m"))


def limits(normalised: DataFrame, margin: float = 0.05) -> DataFrame:
    """Least and greatest height over all, wider by a share of the range."""
    lo, hi = F.min("height_norm_m"), F.max("height_norm_m")
    return normalised.agg((lo - (hi - lo) * margin).alias("low"), (hi + (hi - lo) * margin).alias("high"))
