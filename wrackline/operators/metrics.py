"""How well samples of tide heights cover a reference range, for many groups at once.

Every family is a grouped aggregation over (group, height) rows. Ranks, gaps and quantiles come from levels: the distinct
values of a group with their counts, sorted in buckets between approximate quantiles, so that neither a huge group nor a
value that many rows share ends in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrackline.functions.constants import ADVICE_COVERAGE, ADVICE_GROUPED, ADVICE_REPRESENTATIVE, ADVICE_UNIFORM, ADVICE_VSR, GRADES, KS_TEXTS, UNDEFINED, VMR_TEXTS, VSR_TEXTS
from wrackline.functions.expressions import histogram_bin, share
from wrackline.sources.scratch import stored

from .quantiles import levels, quantile, with_total


def _rows(times: str | None) -> Column:
    """The number of samples in a group: an aggregate."""
    return F.sum(times).cast("bigint") if times else F.count("*")


def _worded(value: Column, texts: list[tuple], fits) -> Column:
    """The text of the first bound that fits(value, bound), the last one if none does."""
    out = F.lit(texts[-1][1])
    for bound, text in reversed(texts[:-1]):
        out = F.when(fits(value, bound), text).otherwise(out)
    return out


def _formatted(value: Column | str, spec: str) -> Column:
    """A number as text, rounded by its exact binary value (5.225 is a little less than that); nan where it is missing."""

    @F.pandas_udf(T.StringType())
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: spec % x)

    return text(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(float("nan"))).cast("double"))


def rank_sorted(samples: DataFrame, g: str = "model", value: str = "height_m") -> DataFrame:
    """g, v, rank: the ascending row number of each value in its group."""
    return levels(samples, [g], value).select(g, "v", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("rank"))


def _gaps(ranked: DataFrame, g: str, distinct: bool = False) -> DataFrame:
    """g, lo, v, gap: of each sample (or level) and the next lower one. ranked: levels of the samples."""
    gaps = ranked.where("lo IS NOT NULL").select(g, "lo", "v")
    if not distinct:
        gaps = gaps.unionByName(ranked.where("n > 1").select(g, F.col("v").alias("lo"), "v", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("n")))).drop("col"))
    return gaps.withColumn("gap", F.col("v") - F.col("lo"))


def neighbour_gaps(samples: DataFrame, g: str = "model", value: str = "height_m", distinct: bool = False) -> DataFrame:
    """g, lo, v, gap: each value with the next lower one. distinct: of levels, not of samples."""
    return _gaps(levels(samples, [g], value), g, distinct)


def _gap_levels(rows: DataFrame, g: str, distinct: bool = False) -> DataFrame:
    """Levels of the gaps between samples (or levels): g, v, n, before, total. rows: levels of the samples."""
    gaps = rows.where("lo IS NOT NULL").select(g, (F.col("v") - F.col("lo")).alias("gap"), F.lit(1).cast("bigint").alias("times"))
    if not distinct:
        gaps = gaps.unionByName(rows.where("n > 1").select(g, F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("times")))
    return with_total(levels(gaps, [g], "gap", times="times"), [g])


def _range(reference: DataFrame, g: str, value: str) -> DataFrame:
    return reference.groupBy(g).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def range_coverage(samples: DataFrame, reference: DataFrame, g: str = "model", value: str = "height_m", on: str | None = None) -> DataFrame:
    """Ranges of samples and reference, and their ratio (0 if the reference has none). on: the key shared with the reference, g by default."""
    on = on or g
    s = samples.groupBy(*{g: 0, on: 0}).agg(F.min(value).alias("min_valido"), F.max(value).alias("max_valido"))
    r = reference.groupBy(on).agg(F.min(value).alias("min_total"), F.max(value).alias("max_total"))
    rows = s.join(r, on).withColumns({"rango_valido": F.col("max_valido") - F.col("min_valido"), "rango_total": F.col("max_total") - F.col("min_total")})
    c = F.when(F.col("rango_total") > 0, share(F.col("rango_valido"), F.col("rango_total"))).otherwise(0.0)
    return rows.withColumns({"cobertura": c, "cobertura_pct": c * 100}).drop(*({on} - {g}))


def _pelz_good(d: float, n: int) -> float:
    """P(D < d) by the expansion of Pelz and Good (1976) in powers of 1/sqrt(n), up to the third."""
    z = d * math.sqrt(n)
    if z < 0.1:
        return 0.0
    z2, z4, z6, z8 = z**2, z**4, z**6, z**8
    sums = [0.0] * 6
    for k in range(-20, 21):
        h = (math.pi * (k + 0.5)) ** 2
        e = math.exp(-h / (2 * z2))
        sums[0] += e
        sums[1] += (h - z2) * e
        sums[2] += (6 * z6 + 2 * z4 + h * (2 * z4 - 5 * z2) + h**2 * (1 - 2 * z2)) * e
        sums[3] += (h**3 * (5 - 30 * z2) + h**2 * (-60 * z2 + 212 * z4) + h * (135 * z4 - 96 * z6) - (30 * z6 + 90 * z8)) * e
        w = (math.pi * k) ** 2
        e = math.exp(-w / (2 * z2))
        sums[4] += w * e
        sums[5] += (3 * w * z2 - w**2) * e
    half = math.sqrt(math.pi / 2)
    first = math.sqrt(2 * math.pi) / z * sums[0] / 2  # each term occurs for k and -k - 1
    second = half / (6 * z4) * sums[1]
    third = half * (sums[2] / (72 * z**7) - sums[4] / (36 * z**3))
    fourth = half * (sums[3] / (6480 * z**10) + sums[5] / (108 * z6))
    return first + second / math.sqrt(n) + third / n + fourth / n**1.5


def ks_pvalue(d: float, n: int) -> float:
    """P(D >= d) of the one-sample Kolmogorov-Smirnov statistic: the exact matrix power (Marsaglia, Tsang, Wang 2003) for
    n up to 400, the expansion of Pelz and Good (1976) beyond, right to 1e-6 there."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    s = n * d * d
    if s > 7.24 or (s > 3.76 and n > 99):  # the same authors' form for the far tail, right to 7 digits
        return 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s)
    return float(min(1.0, max(0.0, 1 - _pelz_good(d, n)))) if n > 400 else _matrix_pvalue(d, n)


def _matrix_pvalue(d: float, n: int) -> float:
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i, j = np.indices((m, m))
    a = np.where(i - j + 1 >= 0, 1.0, 0.0)
    a[:, 0] -= h ** np.arange(1, m + 1)
    a[-1, :] -= h ** np.arange(m, 0, -1)
    a[-1, 0] += max(0.0, 2 * h - 1) ** m
    a = np.where(i - j + 1 > 0, a / np.array([math.factorial(max(0, x)) if x < 171 else math.inf for x in range(m + 2)])[np.maximum(i - j + 1, 0)], a)
    power, scale, base, base_scale, e = np.eye(m), 0, a, 0, n
    while e:
        if e & 1:
            power, scale = power @ base, scale + base_scale
        base, base_scale = base @ base, 2 * base_scale
        e >>= 1
        for name in (0, 1):
            x = power if name == 0 else base
            if x[k - 1, k - 1] > 1e140:
                if name == 0:
                    power, scale = power * 1e-140, scale + 140
                else:
                    base, base_scale = base * 1e-140, base_scale + 140
    s = power[k - 1, k - 1]
    for x in range(1, n + 1):
        s = s * x / n
        if s < 1e-140:
            s, scale = s * 1e140, scale - 140
    return float(min(1.0, max(0.0, 1 - s * 10.0**scale)))


@F.pandas_udf(T.DoubleType())
def _ks_pvalues(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else ks_pvalue(float(a), int(b)) for a, b in zip(d, n, strict=True)], dtype="float64")


def uniformity_ks(samples: DataFrame, reference: DataFrame | None = None, g: str = "model", value: str = "height_m", on: str | None = None, ranked: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance from the uniform distribution on the reference's range (or the samples' own), its p-value and what that means. A range of zero gives NULL."""
    on = on or g
    sizes = samples.where(F.col(value).isNotNull()).groupBy(*{g: 0, on: 0}).agg(_rows(times).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    if reference is not None:
        sizes = sizes.drop("low", "high").join(_range(reference, on, value).select(on, F.col("lo").alias("low"), F.col("hi").alias("high")), on)
    rows = (ranked or levels(samples, [g], value, times=times)).join(sizes.drop(*({on} - {g})), g)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))))
    u = F.when(F.col("high") > F.col("low"), u)
    d = F.max(F.greatest((F.col("before") + F.col("n")) / F.col("total") - u, u - F.col("before") / F.col("total")))
    out = rows.groupBy(g).agg(F.max("total").alias("n"), d.alias("ks_statistic"))
    p = F.col("ks_pvalue")
    text = F.when(p.isNotNull(), _worded(p, KS_TEXTS, lambda v, bound: v > bound))
    return out.withColumn("ks_pvalue", _ks_pvalues("ks_statistic", "n")).withColumns({"uniforme": p > 0.05, "interpretacion": text})


def _binned(samples: DataFrame, reference: DataFrame | None, g: str, value: str, bins: int, on: str, times: str | None) -> DataFrame:
    """g, bin, n: samples in each bin that has one."""
    rows = samples.where(F.col(value).isNotNull()).select(*{g: 0, on: 0}, F.col(value).alias("v"), (F.col(times) if times else F.lit(1)).alias("times"))
    ends = _range(reference, on, value) if reference is not None else samples.groupBy(on).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = rows.join(ends, on).select(g, histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), "times")
    return rows.groupBy(g, "bin").agg(F.sum("times").cast("bigint").alias("n"))


def shannon_entropy(samples: DataFrame, reference: DataFrame | None = None, g: str = "model", value: str = "height_m", bins: int = 20, on: str | None = None, times: str | None = None) -> DataFrame:
    """Entropy (bits) of the histogram on the reference's range. Values outside it are dropped before normalising."""
    counts = _binned(samples, reference, g, value, bins, on or g, times)
    inside = F.col("bin").isNotNull()
    totals = counts.groupBy(g).agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("total"), F.count_if(inside).alias("n_bins_ocupados"), F.sum(F.when(inside, F.col("n") * F.log2("n"))).alias("nlogn"))
    h = F.when(F.col("total") > 0, F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")).otherwise(0.0)
    h = F.when(F.col("n_bins_ocupados") == 1, -0.0).otherwise(h)  # minus the sum of one zero, whatever the logarithms' last digits
    most = math.log2(bins)
    return totals.select(
        g,
        h.alias("entropia"),
        F.lit(most).alias("entropia_max"),
        (h / most if most > 0 else F.lit(0.0)).alias("entropia_norm"),
        F.lit(bins).alias("n_bins"),
        "n_bins_ocupados",
        (bins - F.col("n_bins_ocupados")).alias("n_bins_vacios"),
    )


def dispersion_vmr(samples: DataFrame, g: str = "model", value: str = "height_m", ranked: DataFrame | None = None) -> DataFrame:
    """Variance-to-mean ratio of the gaps and the pattern it means; groups of one sample are undefined."""
    gaps = _gaps(ranked or levels(samples, [g], value), g).groupBy(g).agg(F.avg("gap").alias("media_gaps"), F.var_samp("gap").alias("varianza_gaps"))
    rows = samples.select(g).distinct().join(gaps, g, "left")
    m, v = F.col("media_gaps"), F.col("varianza_gaps")
    vmr = F.when(m > 0, v / m).when(m == 0, F.lit(float("inf")))
    rows = rows.withColumn("vmr", vmr)
    text = F.when(m.isNull(), UNDEFINED).otherwise(F.when(F.col("vmr") < VMR_TEXTS[0][0], VMR_TEXTS[0][1]).when(F.col("vmr") <= VMR_TEXTS[1][0], VMR_TEXTS[1][1]).otherwise(VMR_TEXTS[2][1]))
    return rows.select(g, "vmr", text.alias("patron"), "media_gaps", "varianza_gaps")


def gap_statistics(samples: DataFrame, g: str = "model", value: str = "height_m", ranked: DataFrame | None = None) -> DataFrame:
    """Moments and exact quantiles of the gaps. Skewness and kurtosis are the population's (kurtosis less 3)."""
    rows = ranked or levels(samples, [g], value)
    x = F.col("gap")
    moments = _gaps(rows, g).groupBy(g).agg(
        F.count("*").alias("n_gaps"), F.avg(x).alias("media"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")
    )
    q = lambda p: quantile(p, F.col("total"))
    found = moments.join(_gap_levels(rows, g).groupBy(g).agg(q(0.5).alias("mediana"), q(0.25).alias("p25"), q(0.75).alias("p75")), g)
    cv = F.when(F.col("media") > 0, F.col("std") / F.col("media")).otherwise(F.lit(float("inf")))
    return found.select(g, (F.col("n_gaps") + 1).alias("n_muestras"), "n_gaps", "media", "mediana", "std", cv.alias("cv"), "min", "max", "p25", "p75", (F.col("p75") - F.col("p25")).alias("iqr"), "skewness", "kurtosis")


def vertical_sampling(samples: DataFrame, g: str = "model", value: str = "height_m", ranked: DataFrame | None = None) -> DataFrame:
    """Gaps between distinct levels, the first largest one and where it is, and the quality that their mean means."""
    rows = ranked or levels(samples, [g], value)
    x = F.col("v") - F.col("lo")
    gaps = rows.where("lo IS NOT NULL").groupBy(g).agg(
        F.avg(x).alias("vsr"),
        F.min(x).alias("vsr_min"),
        F.max(x).alias("vsr_max"),
        F.max_by(F.struct("lo", F.col("v").alias("hi")), F.struct(x, -F.col("lo"))).alias("max_gap_ubicacion"),
        (F.count("*") + 1).alias("levels"),
    )
    median = _gap_levels(rows, g, distinct=True).groupBy(g).agg(quantile(0.5, F.col("total")).alias("vsr_mediana"))
    found = samples.where(F.col(value).isNotNull()).select(g).distinct().join(gaps, g, "left").join(median, g, "left")
    v = F.col("vsr")
    text = F.when(v.isNull(), UNDEFINED).otherwise(_worded(v, VSR_TEXTS, lambda v, bound: v <= bound))
    return found.select(g, "vsr", "vsr_mediana", "vsr_min", "vsr_max", F.col("vsr_max").alias("max_gap"), "max_gap_ubicacion", F.coalesce("levels", F.lit(1)).cast("bigint").alias("n_niveles"), text.alias("calidad_vsr"))


def representativeness(samples: DataFrame, reference: DataFrame, g: str = "model", value: str = "height_m", n: int = 10, on: str | None = None, times: str | None = None) -> DataFrame:
    """Share of n equal-width bins of the reference's range that hold a sample, the empty ones, and the counts of all."""
    counts = _binned(samples, reference, g, value, n, on or g, times)
    held = counts.groupBy(g).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    rows = held.select(g, spread.alias("distribucion_muestras"))
    empty = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("distribucion_muestras", i) == 0)
    rows = rows.withColumn("quantiles_vacios", empty).withColumn("quantiles_cubiertos", n - F.size("quantiles_vacios"))
    r = F.col("quantiles_cubiertos") / n
    return rows.select(g, r.alias("representatividad"), (r * 100).alias("representatividad_pct"), "quantiles_cubiertos", F.lit(n).alias("quantiles_totales"), "quantiles_vacios", "distribucion_muestras")


def full_metrics(samples: DataFrame, reference: DataFrame, g: str = "model", value: str = "height_m", bins: int = 20, on: str | None = None, times: str | None = None) -> DataFrame:
    """The seven families as one struct column each; uniformity and entropy on the reference's range.

    Samples become counted values first, and these and their ranks are stored once for all families. times: a column
    that says how many samples a row stands for.
    """
    samples = stored(samples.groupBy(*{g: 0, on or g: 0, value: 0}).agg(_rows(times).alias("times")), "samples")
    ranked = stored(levels(samples, [g], value, times="times"), "levels")
    families = {
        "cobertura": range_coverage(samples, reference, g, value, on),
        "uniformidad_ks": uniformity_ks(samples, reference, g, value, on, ranked, "times"),
        "entropia": shannon_entropy(samples, reference, g, value, bins, on, "times"),
        "dispersion": dispersion_vmr(samples, g, value, ranked),
        "gaps": gap_statistics(samples, g, value, ranked),
        "vsr": vertical_sampling(samples, g, value, ranked),
        "representatividad": representativeness(samples, reference, g, value, 10, on, "times"),
    }
    out = None
    for name, df in families.items():
        one = df.select(g, F.struct(*[c for c in df.columns if c != g]).alias(name))
        out = one if out is None else out.join(one, g, "left")
    return out


def distribution_verdict(metrics: DataFrame, coverage: float = 0.85, entropy: float = 0.70, vmr: float = 1.2, vsr: float = 0.25, representative: float = 0.80) -> DataFrame:
    """Six criteria, how many hold, the grade, whether the essential three hold, and advice. Undefined values hold no criterion.

    The metrics, one row for a group, are stored first: the criteria would otherwise repeat their expressions many times over.
    """
    metrics = stored(metrics, "metrics")
    yes = lambda c: F.coalesce(c, F.lit(False))
    m = metrics.withColumns(
        {
            "cobertura_suficiente": yes(F.col("cobertura.cobertura") >= coverage),
            "uniforme_ks": yes(F.col("uniformidad_ks.uniforme")),
            "entropia_alta": yes(F.col("entropia.entropia_norm") >= entropy),
            "no_agrupado": yes(F.col("dispersion.vmr") <= vmr),
            "vsr_adecuado": yes(F.col("vsr.vsr") <= vsr),
            "representativo": yes(F.col("representatividad.representatividad") >= representative),
        }
    )
    criteria = ["cobertura_suficiente", "uniforme_ks", "entropia_alta", "no_agrupado", "vsr_adecuado", "representativo"]
    n = sum((F.col(c).cast("int") for c in criteria), F.lit(0))
    ratio = F.col("n_criterios_cumplidos") / 6
    grade = _worded(ratio, GRADES, lambda v, bound: v >= bound)
    empty = F.concat(F.lit("["), F.array_join(F.col("representatividad.quantiles_vacios").cast("array<string>"), ", "), F.lit("]"))
    num = _formatted
    advice = F.array_compact(
        F.array(
            F.when(~F.col("cobertura_suficiente"), F.concat(F.lit(ADVICE_COVERAGE[0]), num("cobertura.cobertura_pct", "%.1f"), F.lit(ADVICE_COVERAGE[1]))),
            F.when(~F.col("vsr_adecuado"), F.concat(F.lit(ADVICE_VSR[0]), num("vsr.vsr", "%.3f"), F.lit(ADVICE_VSR[1]))),
            F.when(~F.col("representativo"), F.concat(F.lit(ADVICE_REPRESENTATIVE[0]), num("representatividad.representatividad_pct", "%.1f"), F.lit(ADVICE_REPRESENTATIVE[1]), empty, F.lit(ADVICE_REPRESENTATIVE[2]))),
            F.when(~F.col("uniforme_ks"), F.lit(ADVICE_UNIFORM)),
            F.when(~F.col("no_agrupado"), F.concat(F.lit(ADVICE_GROUPED[0]), num("dispersion.vmr", "%.2f"), F.lit(ADVICE_GROUPED[1]))),
        )
    )
    essential = F.col("cobertura_suficiente") & F.col("vsr_adecuado") & F.col("representativo")
    return m.withColumn("n_criterios_cumplidos", n).withColumns({"calidad_global": grade, "apta": essential, "recomendaciones": advice})


def metric_table(verdict: DataFrame, *keys: str | Column) -> DataFrame:
    """One formatted row for each group, with the key columns (model by default) in front."""
    num = _formatted
    mark = lambda column: F.when(F.col(column), "✓").otherwise("✗")
    cols: dict[str, Column] = {
        "n_obs": F.col("gaps.n_muestras"),
        "cobertura_pct": num("cobertura.cobertura_pct", "%.1f"),
        "rango_m": num("cobertura.rango_valido", "%.2f"),
        "vsr_m": num("vsr.vsr", "%.4f"),
        "niveles": F.col("vsr.n_niveles"),
        "repr_pct": num("representatividad.representatividad_pct", "%.1f"),
        "ks_pval": num("uniformidad_ks.ks_pvalue", "%.4f"),
        "uniforme": mark("uniformidad_ks.uniforme"),
        "entropia_norm": num("entropia.entropia_norm", "%.3f"),
        "vmr_ratio": num("dispersion.vmr", "%.3f"),
        "patron_tipo": F.split(F.col("dispersion.patron"), " ")[0],
        "calidad": F.col("calidad_global"),
        "es_apta": mark("apta"),
        "criterios": F.concat(F.col("n_criterios_cumplidos").cast("string"), F.lit("/6")),
    }
    return verdict.select(*(keys or ("model",)), *[c.alias(n) for n, c in cols.items()])


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Each dated row in every window that starts on or before its date. windows: window, start.

    A window is spread over its days up to the last date of the rows, so that the range condition becomes an equi join on the day.
    """
    last = rows.agg(F.max("scene_date").alias("last")).scalar()
    spread = windows.select("window", "start", last.alias("last")).where("start <= last")
    days = spread.select("window", F.explode(F.sequence(F.col("start").cast("date"), F.col("last").cast("date"))).alias("scene_date"))
    first = rows.agg(F.min("scene_date").alias("first")).scalar()
    return rows.join(days.where(F.col("scene_date") >= first), "scene_date").select(*rows.columns, "window")


def _in_slices(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """model, height_m, slice, times: samples counted once, in the slice of time between two window starts (slice 1 from the first start on)."""
    days = samples.select(F.col("scene_date").cast("date").alias("day")).distinct()
    starts = windows.select(F.col("start").cast("date").alias("day")).distinct()
    marks = days.withColumn("mark", F.lit(0)).unionByName(starts.withColumn("mark", F.lit(1)))
    # one row a day: the calendar, not the samples
    so_far = F.sum("mark").over(Window.partitionBy(F.lit(0)).orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sliced = marks.select("day", "mark", so_far.alias("slice")).where("mark = 0 AND slice > 0").select("day", "slice")
    rows = samples.withColumn("day", F.col("scene_date").cast("date")).join(sliced, "day")
    return rows.groupBy("model", "height_m", "slice").agg(F.count("*").alias("times"))


def window_metrics(samples: DataFrame, reference: DataFrame, windows: DataFrame) -> DataFrame:
    """Metrics of every (window, model) against the model's whole reference. samples: model, scene_date, height_m.

    Windows reach from their start to the end, so later ones lie within earlier ones. A sample is counted in its slice between
    starts, and a window takes the counted values of its own slice and all later ones.
    """
    counted = stored(_in_slices(samples, windows), "slices")
    order = Window.partitionBy(F.lit(0)).orderBy("start")
    starts = windows.select("window", F.col("start").cast("date").alias("start")).withColumn("slice", F.dense_rank().over(order)).drop("start")
    held = counted.select("model", "height_m", "times", F.explode(F.sequence(F.lit(1).cast("bigint"), "slice")).alias("slice")).join(starts.withColumn("slice", F.col("slice").cast("bigint")), "slice")
    rows = held.select(F.struct("window", "model").alias("grp"), "model", "height_m", "times")
    found = distribution_verdict(full_metrics(rows, reference, "grp", on="model", times="times"))
    return found.select(F.initcap(F.regexp_replace("grp.window", "_", " ")).alias("window"), "grp.model", *[c for c in found.columns if c != "grp"])
