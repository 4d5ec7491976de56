"""One cubic spline over each whole series, solved in blocks of bounded size.

The slopes of a not-a-knot spline solve a tridiagonal system over all knots of a series. Here the knots are placed by a range
sort and cut into blocks. A block eliminates its inner unknowns: its first and last slope remain as linear functions of
the slopes just outside. Such a reduced block has six numbers, and neighbouring ones merge into one of the same form, so
runs of them are merged again until one a series is left. On the way back each run gives its members the slopes outside
them, and each block solves for its own. No task holds more than a block or a run, and the result is that of the whole system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrackline.sources.scratch import drop_stored, stored

BLOCK, RUN = 4096, 1024
#: Knots of the neighbours that a block needs for its own rows of the system.
_HALO = 2


def _placed(knots: DataFrame, times: DataFrame) -> DataFrame:
    """Knots with their number (k) in the series, and times with the number of the last knot at or before them (-1 before the first)."""
    none = F.lit(None).cast("double")
    rows = knots.select("node", "t", F.lit(0).alias("kind"), "z").unionByName(times.select("node", "t", F.lit(1).alias("kind"), none.alias("z")))
    rows = rows.repartitionByRange("node", "t", "kind").sortWithinPartitions("node", "t", "kind").withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node = batch.column("node")
            starts = np.ones(n, bool)
            starts[1:] = pc.not_equal(node.slice(1), node.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts[0] = node[0].as_py() != last
            knots = np.cumsum(batch.column("kind").to_numpy() == 0)
            before = np.append(0, knots)[np.flatnonzero(starts)]
            group = np.cumsum(starts)
            base = np.append(-seen, before)  # rows before the first start go on with the count so far
            own = knots - base[group]
            seen, last = int(own[-1]), node[n - 1].as_py()
            yield batch.append_column("seen", pa.array(own, pa.int64()))

    kept = stored(rows.mapInArrow(count, f"node {rows.schema['node'].dataType.simpleString()}, t double, kind int, z double, part int, seen bigint"), "placed")
    totals = kept.groupBy("node", "part").agg(F.max("seen").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(totals.select("node", "part", before.alias("before")), ["node", "part"]).select("node", "t", "kind", "z", (F.col("before") + F.col("seen") - 1).alias("k"))


def _solve(a: np.ndarray, b: np.ndarray, c: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tridiagonal systems with several right sides by parallel cyclic reduction: every row is freed of its neighbours at twice the distance in each step."""
    n, step = len(b), 1
    a, b, c, right = a.copy(), b.copy(), c.copy(), right.copy()
    a[0] = c[-1] = 0.0
    while step < n:
        low, high = np.zeros(n), np.zeros(n)
        low[step:] = -a[step:] / b[:-step]
        high[:-step] = -c[:-step] / b[step:]
        then_a, then_c, then_b, then_right = np.zeros(n), np.zeros(n), b.copy(), right.copy()
        then_a[step:] = low[step:] * a[:-step]
        then_b[step:] += low[step:] * c[:-step]
        then_right[step:] += low[step:, None] * right[:-step]
        then_c[:-step] = high[:-step] * c[step:]
        then_b[:-step] += high[:-step] * a[step:]
        then_right[:-step] += high[:-step, None] * right[step:]
        a, b, c, right = then_a, then_b, then_c, then_right
        step *= 2
    return right / b[:, None]


def _slopes(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """All knots that a block was given, its own ones, and of those y, l, r: slope = y - l * (slope before) - r * (slope after)."""
    rows = block.sort_values("k")
    own = (rows["k"] // rows["size"] == rows["block"]).to_numpy()
    k, x, y = rows["k"].to_numpy(), rows["t"].to_numpy(float), rows["z"].to_numpy(float)
    n = len(rows)
    if k[0] == 0 and n < 4:  # the whole series is a parabola, a line or a point
        c = np.polyfit(x - x[0], y, n - 1)
        slope = np.polyval(np.polyder(c), x - x[0]) if n > 1 else np.zeros(1)
        return rows, rows, np.column_stack([slope, np.zeros(n), np.zeros(n)])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    at = np.flatnonzero(own)
    a, b, c, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    a[1:-1], b[1:-1], c[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    if at[0] == 0:  # the third derivative goes through the second knot
        b[0], c[0] = h[1], h[0] + h[1]
        right[0] = ((h[0] + 2 * c[0]) * h[1] * d[0] + h[0] ** 2 * d[1]) / c[0]
    if at[-1] == n - 1:
        b[-1], a[-1] = h[-2], h[-1] + h[-2]
        right[-1] = (h[-1] ** 2 * d[-2] + (2 * a[-1] + h[-1]) * h[-2] * d[-1]) / a[-1]
    sides = np.zeros((len(at), 3))
    sides[:, 0] = right[at]
    sides[0, 1], sides[-1, 2] = a[at[0]], c[at[-1]]
    return rows, rows[own], _solve(a[at], b[at], c[at], sides)


#: First and last slope of a block as y - l * (slope before) - r * (slope after).
_REDUCED = ["first_y", "first_l", "first_r", "last_y", "last_l", "last_r"]


def _meeting(p: tuple, q: tuple) -> tuple[tuple, tuple]:
    """Of neighbours p and q: the last slope of p and the first of q, each as (constant, factor of the slope before p, factor of the slope after q)."""
    _, _, _, py, pl, pr = p
    qy, ql, qr, _, _, _ = q
    det = 1 - ql * pr
    first = ((qy - ql * py) / det, ql * pl / det, -qr / det)
    return (py - pr * first[0], -pl - pr * first[1], -pr * first[2]), first


def _merged(p: tuple, q: tuple) -> tuple:
    last, first = _meeting(p, q)
    return (p[0] - p[2] * first[0], p[1] + p[2] * first[1], p[2] * first[2], q[3] - q[4] * last[0], q[4] * last[1], q[5] + q[4] * last[2])


def _merge_run(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values("block")
    whole, *rest = rows[_REDUCED].itertuples(index=False, name=None)
    for q in rest:
        whole = _merged(whole, q)
    return pd.DataFrame([whole], columns=_REDUCED).assign(node=rows["node"].iloc[0], block=rows["run"].iloc[0])[["node", "block", *_REDUCED]]


def _split_run(pdf: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
    """The slopes outside each member of a run, from those outside the run."""
    rows = pdf.sort_values("block")
    members = list(rows[_REDUCED].itertuples(index=False, name=None))
    before, after = (float(outside[c].iloc[0]) for c in ("before", "after"))
    prefixes = [members[0]]
    for q in members[1:-1]:
        prefixes.append(_merged(prefixes[-1], q))
    left, right = [0.0] * len(members), [0.0] * len(members)
    left[0], right[-1] = before, after
    for j in range(len(members) - 1, 0, -1):
        last, first = _meeting(prefixes[j - 1], members[j])
        left[j], right[j - 1] = (v[0] + v[1] * before + v[2] * right[j] for v in (last, first))
    return rows[["node", "block"]].assign(before=left, after=right)


def _clean(series: DataFrame) -> DataFrame:
    known = series.where("node IS NOT NULL AND t IS NOT NULL AND z IS NOT NULL AND NOT isnan(z) AND NOT isnan(t)")
    return known.groupBy("node", F.col("t").cast("double").alias("t")).agg(F.avg("z").alias("z"))


def intervals(knots: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(node, k, x, y, s, x1, y1, s1): place, height and slope of each knot (node, t, z, k) and of the one after it, NULL after the last."""
    node = knots.schema["node"].dataType.simpleString()
    size = max(block, 2 * _HALO)
    own, at = F.expr(f"k div {size}"), F.col("k") % size
    shares = F.array_compact(F.array(own, F.when(at < _HALO, own - 1), F.when(at >= size - _HALO, own + 1)))
    parts = knots.select("node", "k", "t", "z", F.lit(size).alias("size"), F.explode(shares).alias("block")).where("block >= 0")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf["k"] // size == pdf["block"]).any():  # neighbours only, beyond the last block
            return pd.DataFrame(columns=["node", "block", *_REDUCED])
        _, _, s = _slopes(pdf)
        return pd.DataFrame([[pdf["node"].iloc[0], pdf["block"].iloc[0], *s[0], *s[-1]]], columns=["node", "block", *_REDUCED])

    reduced = f"node {node}, block bigint, {', '.join(f'{c} double' for c in _REDUCED)}"
    levels = [stored(parts.groupBy("node", "block").applyInPandas(reduce, reduced), "blocks")]
    in_runs = lambda df: df.withColumn("run", F.expr(f"block div {run}"))
    while not levels[-1].where("block > 0").isEmpty():
        levels.append(stored(in_runs(levels[-1]).groupBy("node", "run").applyInPandas(_merge_run, reduced), "runs"))
    outside = levels[-1].select("node", "block", F.lit(0.0).alias("before"), F.lit(0.0).alias("after"))
    for level in reversed(levels[:-1]):
        rows = in_runs(level).groupBy("node", "run").cogroup(outside.withColumnRenamed("block", "run").groupBy("node", "run"))
        outside = stored(rows.applyInPandas(_split_run, f"node {node}, block bigint, before double, after double"), "outside")
    for level in levels[1:]:
        drop_stored(level)

    def finish(pdf: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        names = ["node", "k", "x", "y", "s", "x1", "y1", "s1"]
        if not len(pdf) or not len(out):
            return pd.DataFrame(columns=names)
        rows, mine, s = _slopes(pdf)
        slope = s[:, 0] - s[:, 1] * out["before"].iloc[0] - s[:, 2] * out["after"].iloc[0]
        end = int(np.searchsorted(rows["k"].to_numpy(), mine["k"].iloc[-1])) + 1
        next_x, next_y = (np.append(mine[c].to_numpy(float)[1:], rows[c].iloc[end] if end < len(rows) else np.nan) for c in ("t", "z"))
        next_s = np.append(slope[1:], out["after"].iloc[0] if end < len(rows) else np.nan)
        return pd.DataFrame({"node": mine["node"], "k": mine["k"], "x": mine["t"], "y": mine["z"], "s": slope, "x1": next_x, "y1": next_y, "s1": next_s})[names]

    done = parts.groupBy("node", "block").cogroup(outside.groupBy("node", "block")).applyInPandas(finish, f"node {node}, k bigint, x double, y double, s double, x1 double, y1 double, s1 double")
    return done.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x1", "y1", "s1")})


def spline(times: DataFrame, series: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(node, t, height_m) of every time within its series, once each, by the not-a-knot cubic spline over the whole series.

    times: node, t. series: node, t, z. Unknown values are left out, and values of one time averaged. A series of three or two
    knots is a parabola or a line; a single knot gives no height. Times outside a series, or of no series, are left out.
    """
    asked = times.where("node IS NOT NULL AND t IS NOT NULL").select("node", F.col("t").cast("double").alias("t")).distinct()
    placed = _placed(_clean(series), asked)
    pieces = intervals(placed.where("kind = 0").select("node", "t", "z", "k"), block, run)
    rows = placed.where("kind = 1 AND k >= 0").select("node", "t", "k").join(pieces, ["node", "k"])
    u, h = F.col("t") - F.col("x"), F.col("x1") - F.col("x")
    d = (F.col("y1") - F.col("y")) / h
    c2, c3 = (3 * d - 2 * F.col("s") - F.col("s1")) / h, (F.col("s") + F.col("s1") - 2 * d) / (h * h)
    inner = F.col("y") + u * (F.col("s") + u * (c2 + u * c3))
    height = F.when(F.col("x1").isNotNull(), inner).when((F.col("t") == F.col("x")) & (F.col("k") > 0), F.col("y"))
    return rows.select("node", "t", height.alias("height_m")).where("height_m IS NOT NULL")
