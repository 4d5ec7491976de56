"""Ranks and exact quantiles of huge groups: sorted in buckets between approximate quantiles, never a group in one task.

Equal values are one row with a count, so a value that half of all rows share is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each group, and the accuracy of the sketch that finds their bounds.
BUCKETS, ACCURACY = 64, 2_000


def levels(rows: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS, times: str | None = None) -> DataFrame:
    """keys, v, n (rows of that value; times: a column that says how many a row stands for), before (rows of the group with less), lo (the next lower value). NULLs are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], ACCURACY).alias("cuts"))
    placed = counts.join(cuts, keys).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    ends = placed.groupBy(*keys, "bucket").agg(F.sum("n").alias("all"), F.max("v").alias("top"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    ends = ends.select(*keys, "bucket", F.coalesce(F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("top").over(w).alias("under"))
    own = Window.partitionBy(*keys, "bucket").orderBy("v")
    ranked = placed.select("*", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"), F.lag("v").over(own).alias("prev"))
    return ranked.join(ends, [*keys, "bucket"]).select(*keys, "v", "n", (F.col("base") + F.col("inner")).alias("before"), F.coalesce("prev", "under").alias("lo"))


#: Bins of the selection: so many for each factor of e between magnitudes, about a thousandth of a value wide.
FINE, _ZERO = 1024, 1_000_000


def _bin(v: Column) -> Column:
    """A whole number that never falls as v grows: the place of its magnitude on a logarithmic scale, mirrored below 0."""
    place = lambda x: (F.floor(F.ln(x) * FINE) + _ZERO).cast("int")
    return F.when(v > 0, place(v)).when(v < 0, -place(-v)).otherwise(0)


def selected(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, exact quantiles of each group, in two passes: a histogram, summed before it is shuffled, finds the
    bins that hold the wanted ranks; then the values of these bins alone are counted and ranked. NULLs are left out."""
    v = F.col(value).cast("double")
    binned = rows.where(F.col(value).isNotNull()).select(*keys, v.alias("v"), _bin(v).alias("bin"))
    of_group = Window.partitionBy(*keys)
    upto = F.sum("n").over(of_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n")).select(*keys, "bin", (upto - F.col("n")).alias("base"), upto.alias("upto"), F.sum("n").over(of_group).alias("total"))
    wanted = F.lit(False)
    for p in shares.values():
        for k in (F.floor(p * (F.col("total") - 1)), F.ceil(p * (F.col("total") - 1))):
            wanted = wanted | ((F.col("base") <= k) & (k < F.col("upto")))
    held = bins.where(wanted).select(F.struct(*keys, "bin").alias("key"), "base", "total")
    inner = binned.join(held, F.struct(*keys, "bin").eqNullSafe(F.col("key"))).groupBy(*keys, "bin", "base", "total", "v").agg(F.count("*").alias("n"))
    less = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = inner.select(*keys, "v", "n", "total", (F.col("base") + less).alias("before"))
    return ranked.groupBy(*keys).agg(*[quantile(p, F.col("total")).alias(name) for name, p in shares.items()])


def quantile(p: float, total: Column) -> Column:
    """The p-quantile of levels with their group's total, by linear interpolation between ranks: an aggregate."""
    rank = p * (total - 1)
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))
    low, high = F.floor(rank), F.ceil(rank)
    return at(low) + (at(high) - at(low)) * F.max(rank - low)


def with_total(levels_: DataFrame, keys: list[str]) -> DataFrame:
    """Adds total, the rows of the group."""
    return levels_.join(levels_.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
