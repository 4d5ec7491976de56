"""Spatial operators on pixel tables and polygons.

Distances are found in tiles of strips of rows: a tile gets its own pixels, of each column the nearest background above and
below it, and from other tiles of its strip the background that is nearest somewhere in it, so a task is bounded both ways
and nothing is spread over a radius. Buffers are distances up to a limit.
Connected components label tiles in bounded tasks and join labels across tile edges. Polygons meet pixels and cells in
stretches of rows, where their edges cross, in equi joins; rings are put in order by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.operators.places import numbered
from wrackline.sources.scratch import drop_stored, stored

TILE, STRIP, WIDE, BAND = 512, 64, 4096, 1024
_FAR = 1 << 40


def _gaps(background: pd.DataFrame, y0: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns that have background, and for each row of the strip the rows to the nearest of it in each column."""
    columns = np.unique(background["x"].to_numpy(np.int64))
    y, at = background["y"].to_numpy(np.int64), np.searchsorted(columns, background["x"].to_numpy(np.int64))
    above, below = np.full((rows + 1, len(columns)), -_FAR), np.full((rows + 1, len(columns)), _FAR)
    up, down = y < y0, y >= y0 + rows
    above[0, at[up]] = y[up]
    below[rows, at[down]] = y[down]
    inner = ~up & ~down
    above[1 + y[inner] - y0, at[inner]] = y[inner]
    below[y[inner] - y0, at[inner]] = y[inner]
    places = y0 + np.arange(rows)[:, None]
    return columns, np.minimum(places - np.maximum.accumulate(above)[1:], np.minimum.accumulate(below[::-1])[::-1][:rows] - places)


class Steps:
    """Least gap plus columns to it."""

    size = staticmethod(lambda dy, dx: dy + dx)

    def __init__(self, columns: np.ndarray, gaps: np.ndarray):
        self.columns, self.gaps = columns, gaps

    def least(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        columns, gaps = self.columns, self.gaps
        left, right = np.minimum.accumulate(gaps - columns, axis=1), np.minimum.accumulate((gaps + columns)[:, ::-1], axis=1)[:, ::-1]
        i = np.searchsorted(columns, x, side="right") - 1
        j = np.searchsorted(columns, x, side="left")
        a = np.where(i >= 0, left[row, np.maximum(i, 0)] + x, _FAR)
        b = np.where(j < len(columns), right[row, np.minimum(j, len(columns) - 1)] - x, _FAR)
        return np.minimum(a, b)

    def winners(self, x0: int, x1: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) that are nearest to a place in [x0, x1), which lies beside the columns: one a row is nearest to all of them."""
        best = np.argmin(self.gaps - self.columns if x0 > self.columns[-1] else self.gaps + self.columns, axis=1)
        return np.arange(len(self.gaps)), best


class Squares:
    """Least squared gap plus squared columns to it, by the lower envelope of the columns' parabolas: of all rows in step, a column at a time."""

    size = staticmethod(lambda dy, dx: dy * dy + dx * dx)

    def __init__(self, columns: np.ndarray, gaps: np.ndarray):
        n = len(gaps)
        stack, start, top = np.zeros((n, len(columns)), np.int64), np.full((n, len(columns)), -np.inf), np.full(n, -1)
        high = gaps.astype(float) ** 2
        for j, q in enumerate(columns):
            rows = np.flatnonzero(gaps[:, j] < _FAR // 2)
            cut = np.full(len(rows), -np.inf)
            while True:
                held = np.flatnonzero(top[rows] >= 0)
                r = rows[held]
                p = stack[r, top[r]]
                s = (high[r, j] - high[r, p] + float(q) ** 2 - columns[p].astype(float) ** 2) / (2.0 * (q - columns[p]))
                cut[:] = -np.inf
                cut[held] = s
                gone = r[s <= start[r, top[r]]]
                if not len(gone):
                    break
                top[gone] -= 1
            top[rows] += 1
            stack[rows, top[rows]] = j
            start[rows, top[rows]] = cut
        self.columns, self.gaps, self.stack, self.start, self.top = columns, gaps, stack, start, top

    def least(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), _FAR)
        order = np.argsort(row, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
            r = row[own[0]]
            if self.top[r] >= 0:
                j = self.stack[r, np.maximum(np.searchsorted(self.start[r, : self.top[r] + 1], x[own], side="right") - 1, 0)]
                out[own] = self.gaps[r, j] ** 2 + (x[own] - self.columns[j]) ** 2
        return out

    def winners(self, x0: int, x1: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the parabolas that are lowest somewhere in [x0, x1)."""
        rows, columns = [], []
        for r in np.flatnonzero(self.top >= 0):
            i, j = np.maximum(np.searchsorted(self.start[r, : self.top[r] + 1], [x0, x1 - 1], side="right") - 1, 0)
            rows.append(np.full(j - i + 1, r))
            columns.append(self.stack[r, i : j + 1])
        return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pairs(background: DataFrame, wanted: DataFrame, metric, limit: int | None, strip: int, tile: int) -> DataFrame:
    """(strip, tile, to): tiles whose background may be nearest to a wanted pixel of another tile of the strip.

    A tile is summed up in one row: between which columns it has background, how near that comes to the strip's rows, and
    a column that surely has some near all of them. These rows alone, a row a tile, meet by strip.
    """
    y0 = F.col("strip") * strip
    inside = (F.col("y") >= y0) & (F.col("y") < y0 + strip)
    to_first, to_last = F.abs(F.col("y") - y0), F.abs(F.col("y") - y0 - strip + 1)
    columns = background.groupBy("strip", "tile", "x").agg(F.min(F.greatest(to_first, to_last)).alias("most"), F.min(F.when(inside, F.lit(0)).otherwise(F.least(to_first, to_last))).alias("near"))
    sums = columns.groupBy("strip", "tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("near").alias("near"), F.min(F.struct("most", "x")).alias("sure"))
    sums = sums.select("strip", "tile", "x0", "x1", "near", F.col("sure.most").alias("most"), F.col("sure.x").alias("at"))
    none = F.lit(None).cast("int")
    asked = wanted.select("strip", "tile").distinct().select("strip", "tile", *[none.alias(c) for c in ("x0", "x1", "near", "most", "at")])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        have, ask = pdf[pdf["x0"].notna()], pdf[pdf["x0"].isna()]
        x0, x1, near, most, at, own = (have[c].to_numpy(np.int64) for c in ("x0", "x1", "near", "most", "at", "tile"))
        found = []
        for t in ask["tile"].to_numpy(np.int64) if len(have) else ():
            low, high = t * tile, t * tile + tile - 1
            bound = metric.size(most, np.maximum(np.abs(low - at), np.abs(high - at))).min()
            bound = bound if limit is None else min(bound, metric.size(limit, 0))
            near_by = (metric.size(near, np.maximum(np.maximum(x0 - high, low - x1), 0)) <= bound) & (own != t)
            found += [(key[0], i, t) for i in own[near_by]]
        return pd.DataFrame(found, columns=["strip", "tile", "to"])

    return sums.unionByName(asked).groupBy("strip").applyInPandas(run, "strip int, tile int, to int")


def _distances(mask: DataFrame, metric, limit: int | None = None, strip: int = STRIP, tile: int = WIDE) -> DataFrame:
    """(y, x, d) of the wanted pixels of mask (y, x, inside, want): d to the nearest pixel that isn't inside; NULL if there is none in reach.

    metric: Squares or Steps. limit: background farther away in its column may be left out. A task has a tile of a strip of
    rows: its own pixels, the nearest background above and below of each column, and from other tiles of the strip only
    the background that is nearest somewhere in this tile.
    """
    cell = lambda c, n: F.floor(F.col(c) / n).cast("int")
    rows = mask.select("y", "x", "inside", "want", cell("y", strip).alias("strip"), cell("x", tile).alias("tile"))
    # one row a column of a strip: all that tiles need to know of each other
    out = F.when(~F.col("inside"), F.col("y"))
    columns = stored(rows.groupBy("strip", "tile", "x").agg(F.min(out).alias("low"), F.max(out).alias("high"), F.bool_or("want").alias("want")), "columns")
    ends = columns.where("low IS NOT NULL").select("x", "tile", "strip", "low", "high")
    w = Window.partitionBy("x").orderBy("strip")
    near = ends.select("x", "tile", "strip", "low", "high", F.lag("strip").over(w).alias("before"), F.lead("strip").over(w).alias("after"))
    if limit is None:
        ends_of = columns.agg(F.struct(F.min("strip").alias("first"), F.max("strip").alias("last")).alias("strips")).scalar()
        first, last = ends_of["first"], ends_of["last"]
    else:
        first, last = F.floor((F.col("low") - limit) / strip).cast("int"), F.floor((F.col("high") + limit) / strip).cast("int")
    near = near.select("x", "tile", "strip", "low", "high", F.greatest(F.coalesce("before", first), first).alias("from"), F.least(F.coalesce("after", last), last).alias("to"))
    span = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    none = F.lit(None).cast("boolean")
    up = near.select(F.col("high").alias("y"), "x", none.alias("inside"), F.lit(False).alias("want"), span(F.col("strip") + 1, F.col("to")).alias("strip"), "tile")
    down = near.select(F.col("low").alias("y"), "x", none.alias("inside"), F.lit(False).alias("want"), span(F.col("from"), F.col("strip") - 1).alias("strip"), "tile")
    carried = up.unionByName(down)
    background = rows.where(~F.col("inside")).unionByName(carried)

    def solve(key: tuple, pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        own, held = pdf[pdf["want"]], pdf[pdf["inside"].isna() | (pdf["inside"] == False)]  # noqa: E712
        y0, y = int(key[0]) * strip, own["y"].to_numpy(np.int64)
        columns, gaps = _gaps(held, y0, strip) if len(held) else (np.zeros(0, np.int64), np.zeros((strip, 0), np.int64))
        if len(sent):
            more = np.unique(sent["x"].to_numpy(np.int64))
            wide = np.full((strip, len(more)), _FAR)
            wide[sent["y"].to_numpy(np.int64) - y0, np.searchsorted(more, sent["x"].to_numpy(np.int64))] = sent["gap"].to_numpy(np.int64)
            columns = np.concatenate([columns, more])
            order = np.argsort(columns)
            columns, gaps = columns[order], np.concatenate([gaps, wide], axis=1)[:, order]
        d = metric(columns, gaps).least(y - y0, own["x"].to_numpy(np.int64)) if len(columns) and len(own) else np.full(len(own), _FAR)
        return own[["y", "x"]].assign(d=pd.array(d, "Int64")).assign(d=lambda f: f["d"].mask(d >= _FAR // 2))

    known = ends.select(F.explode(F.array("low", "high")).alias("y"), "x", "strip", "tile").unionByName(carried.select("y", "x", "strip", "tile"))
    pairs = stored(_pairs(known, columns.where("want"), metric, limit, strip, tile), "pairs")
    of_tile = rows.where(F.col("want") | ~F.col("inside")).unionByName(carried)
    if pairs.isEmpty():  # no tile needs another's background
        return of_tile.groupBy("strip", "tile").applyInPandas(lambda key, pdf: solve(key, pdf, ()), "y int, x int, d bigint")

    def send(key: tuple, pdf: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(to):
            y0 = int(key[0]) * strip
            columns, gaps = _gaps(pdf, y0, strip)
            lines = metric(columns, gaps)
            for t in to["to"].to_numpy(np.int64):
                row, j = lines.winners(t * tile, t * tile + tile)
                out.append(pd.DataFrame({"strip": key[0], "tile": t, "y": y0 + row, "x": columns[j], "gap": gaps[row, j]}))
        return pd.concat(out).query(f"gap < {_FAR // 2}") if out else pd.DataFrame(columns=["strip", "tile", "y", "x", "gap"])

    asked = background.join(pairs.select("strip", "tile").distinct(), ["strip", "tile"], "left_semi")
    sent = asked.groupBy("strip", "tile").cogroup(pairs.groupBy("strip", "tile")).applyInPandas(send, "strip int, tile int, y int, x int, gap bigint")
    return of_tile.groupBy("strip", "tile").cogroup(sent.groupBy("strip", "tile")).applyInPandas(solve, "y int, x int, d bigint")


def near_background(mask: DataFrame, reach: int, metric=Squares) -> DataFrame:
    """Pixels (y, x) of mask (y, x, inside, perhaps want) at most `reach` from a pixel that isn't inside."""
    mask = mask if "want" in mask.columns else mask.withColumn("want", F.lit(True))
    if reach == 0:  # only these pixels themselves
        return mask.where(F.col("want") & ~F.col("inside")).select("y", "x")
    return _distances(mask, metric, reach).where(F.col("d") <= metric.size(reach, 0)).select("y", "x")


def _against(frame: DataFrame, pixels: DataFrame) -> DataFrame:
    """A mask of frame and pixels: inside is what isn't in pixels, wanted is the frame."""
    both = frame.select("y", "x", F.lit(True).alias("f"), F.lit(False).alias("p")).unionByName(pixels.select("y", "x", F.lit(False).alias("f"), F.lit(True).alias("p")))
    return both.groupBy("y", "x").agg(F.bool_or("f").alias("want"), (~F.bool_or("p")).alias("inside"))


def within_radius(frame: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels of the frame at most `radius` (Euclidean) from a pixel of the set."""
    return near_background(_against(frame, pixels), radius)


def dilate(pixels: DataFrame, frame: DataFrame, steps: int) -> DataFrame:
    """Binary dilation by `steps` of a 4-neighbour cross, clipped to the frame."""
    return near_background(_against(frame, pixels), steps, Steps)


def column_distance(mask: DataFrame) -> DataFrame:
    """mask: y, x, inside. gap: rows to the nearest pixel of the column that isn't inside; NULL if it has none."""
    w = Window.partitionBy("x").orderBy("y")
    out = F.when(~F.col("inside"), F.col("y"))
    above = F.last(out, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(out, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return mask.select("y", "x", "inside", F.least(F.col("y") - above, below - F.col("y")).alias("gap"))


def distance_transform(mask: DataFrame, strip: int = STRIP, tile: int = WIDE) -> DataFrame:
    """d2: the squared Euclidean distance to the nearest pixel that isn't inside; NULL if there is none. Outside the raster isn't background, nor are pixels absent from mask."""
    return _distances(mask.withColumn("want", F.lit(True)), Squares, None, strip, tile).withColumnRenamed("d", "d2")


def argmax_pixel(values: DataFrame, value: str) -> DataFrame:
    """The pixel of the greatest value, the first in row-major order among equals."""
    best = F.max_by(F.struct("y", "x", value), F.struct(F.col(value), -F.col("y"), -F.col("x"))).alias("p")
    return values.where(F.col(value).isNotNull()).agg(best).select("p.*")


def pixel_to_coord(pixels: DataFrame, transform: tuple, anchor: str = "corner") -> DataFrame:
    """Adds lon, lat by an affine transform (a, b, c, d, e, f) of (column, row); anchor: upper-left corner or centre."""
    a, b, c, d, e, f = transform
    h = 0.5 if anchor == "center" else 0.0
    col, row = F.col("x") + h, F.col("y") + h
    return pixels.withColumns({"lon": a * col + b * row + c, "lat": d * col + e * row + f})


def raster_extent(grid: DataFrame) -> DataFrame:
    """left, right, bottom, top of rasters given by a, c, e, f, height, width."""
    return grid.select(F.col("c").alias("left"), (F.col("c") + F.col("a") * F.col("width")).alias("right"), (F.col("f") + F.col("e") * F.col("height")).alias("bottom"), F.col("f").alias("top"))


def water_pole(reference_map: DataFrame, transform: tuple) -> DataFrame:
    """The stable-water pixel farthest from everything else. If there is no water, reading the result raises."""
    far = distance_transform(reference_map.select("y", "x", (F.col("cls") == 1).alias("inside")))
    water = far.join(reference_map.where("cls = 1").select("y", "x"), ["y", "x"], "left_semi")
    best = F.max_by(F.struct("y", "x", "d2"), F.struct(F.col("d2"), -F.col("y"), -F.col("x")))
    # without water the aggregate has no pixel; without anything else the distances are NULL
    none = F.when(F.count("*") == 0, F.raise_error(F.lit("the map has no stable water")).cast("struct<y:int,x:int,d2:bigint>"))
    found = water.agg(F.coalesce(none, best).alias("p")).select("p.*")
    return pixel_to_coord(found.where("d2 IS NOT NULL"), transform)


def _edges(vertices: DataFrame) -> DataFrame:
    """Directed edges (x1, y1, x2, y2) of a ring given by vertex_no, vx, vy: every vertex meets its successor by number, the last one the first."""
    v = numbered(vertices.select("vertex_no", F.col("vx").cast("double").alias("vx"), F.col("vy").cast("double").alias("vy")), "vertex_no", "vx", "vy")
    last = v.agg(F.max("place")).scalar()
    ahead = F.when(F.col("place") == last, F.lit(0)).otherwise(F.col("place") + 1)
    ends = v.select(F.col("place").alias("ahead"), F.col("vx").alias("x2"), F.col("vy").alias("y2"))
    return v.select(F.col("vx").alias("x1"), F.col("vy").alias("y1"), ahead.alias("ahead")).join(ends, "ahead").drop("ahead")


def polygon_centroid(vertices: DataFrame) -> DataFrame:
    """Area centroid by the shoelace sums."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = _edges(vertices).agg(F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    return sums.select(F.try_divide("sx", 3 * F.col("a")).alias("cx"), F.try_divide("sy", 3 * F.col("a")).alias("cy"))


def polygon_bbox(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.min("vx").alias("west"), F.min("vy").alias("south"), F.max("vx").alias("east"), F.max("vy").alias("north"))


def make_polygon(vertices: DataFrame, text: str = "dms") -> DataFrame:
    """One ring of (lon, lat) from DMS vertices in order."""
    from wrackline.functions.expressions import dms_parts

    lat, lon = dms_parts(F.col(text))
    return vertices.select("vertex_no", lon.alias("lon"), lat.alias("lat")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex_no", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("ring"))


def extent_pad(vertices: DataFrame, pad: float = 0.05) -> DataFrame:
    """The bounding box, wider by a share of its size on every side."""
    b = polygon_bbox(vertices).selectExpr("double(west) west", "double(south) south", "double(east) east", "double(north) north")
    w, h = (F.col("east") - F.col("west")) * pad, (F.col("north") - F.col("south")) * pad
    return b.select((F.col("west") - w).alias("left"), (F.col("east") + w).alias("right"), (F.col("south") - h).alias("bottom"), (F.col("north") + h).alias("top"))


def _crossings(edges: DataFrame, origin: Column, step: Column) -> DataFrame:
    """line, cut: where the edges cross the horizontal lines y = origin + line * step. Long edges are listed in stretches of lines."""
    line = lambda f: F.floor((f("y1", "y2") - origin) / step).cast("int")
    rows = edges.where("y1 <> y2").withColumns({"low": line(F.least), "high": line(F.greatest) + 1})
    rows = rows.withColumn("band", F.explode(F.sequence("low", "high", F.lit(BAND))))
    rows = rows.withColumn("line", F.explode(F.sequence("band", F.least(F.col("band") + BAND - 1, F.col("high")))))
    y = origin + F.col("line") * step
    cut = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return rows.where((F.col("y1") > y) != (F.col("y2") > y)).select("line", cut.alias("cut"))


def _inner(cuts: DataFrame, last_before: Column) -> DataFrame:
    """line, stretch, marks, odd: the even-odd rule for places 0, 1, 2, ... of each line, in stretches of BAND places.

    last_before: of a cut, the last place before it. Cuts between the same places cancel in pairs, so a stretch has one
    mark a place at most. A place is inside if the marks at or after it in its stretch and those beyond it (odd) are odd in number.
    """
    marks = cuts.select("line", last_before.cast("bigint").alias("m")).groupBy("line", "m").agg(F.count("*").alias("n")).where("n % 2 = 1")
    rows = marks.groupBy("line", F.floor(F.col("m") / BAND).alias("stretch")).agg(F.collect_list("m").alias("marks"))
    w = Window.partitionBy("line").orderBy("stretch")  # a row a stretch
    beyond = F.coalesce(F.sum(F.size("marks")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) % 2 == 1
    rows = rows.select("line", "stretch", "marks", beyond.alias("odd"), F.lag("stretch").over(w).alias("before"))
    # stretches without a mark are inside or outside as a whole; only the former are listed
    between = rows.where(F.col("odd") != (F.size("marks") % 2 == 1)).where(F.coalesce(F.col("stretch") - F.col("before"), F.lit(2)) > 1)
    between = between.select("line", F.explode(F.sequence(F.coalesce(F.col("before") + 1, F.least(F.lit(0), F.col("stretch") - 1)), F.col("stretch") - 1)).alias("stretch"), F.array().cast("array<bigint>").alias("marks"), F.lit(True).alias("odd"))
    return rows.drop("before").unionByName(between)


def _is_inside(place: Column, marks: Column, odd: Column) -> Column:
    return F.coalesce((F.size(F.filter(marks, lambda m: m >= place)) % 2 == 1) != odd, F.lit(False))


def aoi_mask(pixels: DataFrame, vertices: DataFrame) -> DataFrame:
    """in_aoi: whether the pixel's centre lies in the polygon (in pixel units), by the edges that cross its row."""
    lines = _inner(_crossings(_edges(vertices), F.lit(0.5), F.lit(1.0)), F.ceil(F.col("cut") - 0.5) - 1)
    lines = lines.select(F.col("line").alias("aoi_line"), F.col("stretch").alias("aoi_stretch"), F.col("marks").alias("aoi_marks"), F.col("odd").alias("aoi_odd"))
    found = pixels.join(lines, (pixels["y"] == F.col("aoi_line")) & (F.floor(pixels["x"] / BAND) == F.col("aoi_stretch")), "left")
    return found.withColumn("in_aoi", _is_inside(F.col("x"), F.col("aoi_marks"), F.col("aoi_odd"))).drop("aoi_line", "aoi_stretch", "aoi_marks", "aoi_odd")


def bbox_filter(points: DataFrame, bbox: tuple, start: str | None = None, end: str | None = None) -> DataFrame:
    """Points in (west, south, east, north), from start to the whole of the day end."""
    west, south, east, north = bbox
    rows = points.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    if start:
        rows = rows.where((F.col("scene_date") >= F.to_date(F.lit(start))) & (F.col("scene_date") < F.date_add(F.to_date(F.lit(end)), 1)))
    return rows


def make_grid(vertices: DataFrame, size: float) -> DataFrame:
    """Square cells over the bounding box, from its lower corner and half-open, that touch the polygon.

    A cell touches it if a corner lies in the ring, a vertex in the cell, or an edge crosses a side. Corners meet the edges
    that cross their row of the grid; every edge is taken to the cells along its way, and tested there.
    """
    b = polygon_bbox(vertices)
    n = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / size).cast("int") - 1, F.lit(0))
    box = b.select(F.col("west").cast("double").alias("west"), F.col("south").cast("double").alias("south"), n("west", "east").alias("last_i"), n("south", "north").alias("last_j"))
    west, south, last_i, last_j = (box.select(c).scalar() for c in ("west", "south", "last_i", "last_j"))
    cells = box.select("west", "south", "last_j", F.explode(F.sequence(F.lit(0), F.col("last_i"))).alias("i")).repartition("i").select("*", F.explode(F.sequence(F.lit(0), F.col("last_j"))).alias("j"))
    square = lambda df: df.withColumns({"x0": F.col("west") + F.col("i") * size, "y0": F.col("south") + F.col("j") * size}).withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size})
    cells = square(cells).select("i", "j", "x0", "y0", "x1", "y1")

    edges = _edges(vertices).withColumns({"west": west, "south": south, "last_i": last_i, "last_j": last_j})
    cuts = _crossings(edges, F.col("south"), F.lit(float(size))).withColumn("west", west)
    near = F.ceil((F.col("cut") - F.col("west")) / size) - 1
    ahead = lambda i: F.col("west") + i * size < F.col("cut")
    lines = _inner(cuts, F.when(ahead(near + 1), near + 1).when(ahead(near), near).otherwise(near - 1))
    # a corner i of line j belongs to the cells (i, j), (i - 1, j), (i, j - 1) and (i - 1, j - 1); the last corner of a stretch is the first cell's of the next
    side = lambda name, up: lines.select((F.col("line") - up).alias("j"), F.col("stretch").alias("stretch"), F.struct("marks", "odd").alias(name))
    cornered = cells.withColumn("stretch", F.floor(F.col("i") / BAND))
    cornered = cornered.join(side("low", 0), ["j", "stretch"], "left").join(side("high", 1), ["j", "stretch"], "left")
    over = lambda name: F.when(F.col("i") % BAND < BAND - 1, _is_inside(F.col("i") + 1, F.col(f"{name}.marks"), F.col(f"{name}.odd")))
    corner = F.lit(False)
    for name in ("low", "high"):
        corner = corner | _is_inside(F.col("i"), F.col(f"{name}.marks"), F.col(f"{name}.odd")) | F.coalesce(over(name), F.lit(False))
    edge_corner = lines.where(_is_inside(F.col("stretch") * BAND, F.col("marks"), F.col("odd"))).select((F.col("stretch") * BAND - 1).cast("int").alias("i"), "line")
    edge_corner = edge_corner.select("i", F.explode(F.array(F.col("line"), F.col("line") - 1)).alias("j"))

    e = edges.select(*[F.col(c).alias(f"e{c}") for c in ("x1", "y1", "x2", "y2")], "west", "south", "last_i", "last_j")
    place = lambda v, origin: F.floor((v - F.col(origin)) / size).cast("int")
    between = lambda a, z, last: F.sequence(F.greatest(a - 1, F.lit(0)), F.least(z + 1, F.col(last)))
    e = e.withColumn("j", F.explode(between(place(F.least("ey1", "ey2"), "south"), place(F.greatest("ey1", "ey2"), "south"), "last_j")))
    # the stretch of x over which the edge lies in row j
    reach = lambda y: F.greatest(F.least("ey1", "ey2"), F.least(F.greatest("ey1", "ey2"), y))
    at = lambda y: F.when(F.col("ey1") == F.col("ey2"), F.lit(None)).otherwise(F.col("ex1") + (reach(y) - F.col("ey1")) * (F.col("ex2") - F.col("ex1")) / (F.col("ey2") - F.col("ey1")))
    a, z = at(F.col("south") + F.col("j") * size), at(F.col("south") + (F.col("j") + 1) * size)
    x_low, x_high = F.coalesce(F.least(a, z), F.least("ex1", "ex2")), F.coalesce(F.greatest(a, z), F.greatest("ex1", "ex2"))
    e = square(e.withColumn("i", F.explode(between(place(x_low, "west"), place(x_high, "west"), "last_i"))))
    held = F.col("ex1").between(F.col("x0"), F.col("x1")) & F.col("ey1").between(F.col("y0"), F.col("y1"))
    dx, dy = F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    sides = [F.signum(dx * (F.col(y) - F.col("ey1")) - dy * (F.col(x) - F.col("ex1"))) for x in ("x0", "x1") for y in ("y0", "y1")]
    across = (F.least("ex1", "ex2") <= F.col("x1")) & (F.greatest("ex1", "ex2") >= F.col("x0")) & (F.least("ey1", "ey2") <= F.col("y1")) & (F.greatest("ey1", "ey2") >= F.col("y0"))
    met = e.where(held | ((F.least(*sides) <= 0) & (F.greatest(*sides) >= 0) & across)).select("i", "j").unionByName(edge_corner).distinct().withColumn("met", F.lit(True))
    return cornered.join(met, ["i", "j"], "left").where(corner | F.col("met")).select("i", "j", "x0", "y0", "x1", "y1")


def outline_edges(pixels: DataFrame) -> DataFrame:
    """Directed unit edges (x1, y1, x2, y2) of the outline of a pixel set: those that no neighbour shares."""
    x, y = F.col("x"), F.col("y")
    sides = [(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)]
    edge = F.explode(F.array(*[F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")) for a, b, c, d in sides]))
    e = pixels.select(edge.alias("e")).select("e.*")
    e = e.withColumn("key", F.struct(F.least(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))).alias("p"), F.greatest(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))).alias("q")))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("x1", "y1", "x2", "y2")).alias("e")).where("n = 1").select("e.*")


def _tile_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    y0, x0 = y.min(), x.min()
    big = np.iinfo(np.int64).max
    label = np.full((y.max() - y0 + 2, x.max() - x0 + 2), big)
    label[y - y0, x - x0] = pdf["id"].to_numpy(np.int64)
    while True:  # sweep each row and column run to its least label
        old = label.copy()
        for axis in (0, 1):
            for flip in (False, True):
                a = label if axis == 0 else label.T
                a = a[::-1] if flip else a
                for i in range(1, len(a)):
                    held = (a[i] != big) & (a[i - 1] != big)
                    a[i] = np.where(held, np.minimum(a[i], a[i - 1]), a[i])
        if (old == label).all():
            break
    return pdf[["ty", "tx", "y", "x"]].assign(label=label[y - y0, x - x0])


#: Labels of one part, which may reach over very many tiles, meet what is known of it under so many keys.
SALTS = 64


def _met(rows: DataFrame, known: DataFrame, key: str, by: str) -> DataFrame:
    """rows left-joined with known (one row a key) on key. A key that many rows share is looked up once for each of SALTS shares of them."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return rows.join(rows.select(key, "salt").distinct().join(known, key), [key, "salt"], "left").drop("salt")


def connected_components(pixels: DataFrame, width: int, tile: int = TILE, store=stored) -> DataFrame:
    """4-connected parts of a pixel set: component (the least id, y * width + x, of its pixels) and size.

    Tiles are labelled in bounded tasks; labels that touch across tile edges are joined by least-label steps until
    nothing changes. Only edge pixels take part in that. Sizes are summed over labels, each counted in its tile, and
    pixels learn part and size of their label within their tile. store: cuts the lineage between steps; by default it
    writes a table to the shared folder.
    """
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = pixels.select("y", "x", (F.col("y").cast("bigint") * width + F.col("x")).alias("id"), cell("y").alias("ty"), cell("x").alias("tx"))
    local = store(rows.groupBy("ty", "tx").applyInPandas(_tile_labels, "ty int, tx int, y int, x int, label bigint"))
    labels = store(local.groupBy("ty", "tx", "label").agg(F.count("*").alias("n")))
    at = lambda c, place: F.pmod(F.col(c), F.lit(tile)) == place
    before = local.where(at("y", 0)).select(F.col("label").alias("a"), F.col("y") - 1, "x").toDF("a", "y", "x").unionByName(local.where(at("x", 0)).select(F.col("label").alias("a"), "y", F.col("x") - 1).toDF("a", "y", "x"))
    links = before.join(local.where(at("y", tile - 1) | at("x", tile - 1)).select("y", "x", F.col("label").alias("b")), ["y", "x"]).select("a", "b").distinct()
    links = store(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    root = store(links.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        low = links.join(root.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        hop = _met(root, root.select(F.col("node").alias("root"), F.col("root").alias("after")), "root", "node")
        then = store(hop.join(low, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("after", "root"), F.coalesce("low", "root")).alias("root")))
        settled = then.where("root <> was").isEmpty()
        if store is stored:
            drop_stored(root)
        root = then.select("node", "root")
        if settled:
            break
    parts = labels.join(root.withColumnRenamed("node", "label"), "label", "left").select("ty", "tx", "label", "n", F.coalesce("root", "label").alias("component"))
    sizes = parts.groupBy("component").agg(F.sum("n").alias("size"))
    return local.join(_met(parts.drop("n"), sizes, "component", "label"), ["ty", "tx", "label"]).select("y", "x", "component", "size")


def despeckle(freq: DataFrame, width: int, min_size: int = 6) -> DataFrame:
    """Islands of known values under min_size pixels become NULL."""
    parts = connected_components(freq.where("water_freq IS NOT NULL").select("y", "x"), width)
    small = parts.where(F.col("size") < min_size).select("y", "x", F.lit(True).alias("small"))
    return freq.join(small, ["y", "x"], "left").select("y", "x", F.when(F.col("small").isNull(), F.col("water_freq")).alias("water_freq"))


def remove_isolated_water(freq: DataFrame, width: int, above: float = 0.15, min_size: int = 20) -> DataFrame:
    """Patches above a frequency that are under min_size pixels become 0."""
    parts = connected_components(freq.where(F.coalesce("water_freq", F.lit(0.0)) > above).select("y", "x"), width)
    small = parts.where(F.col("size") < min_size).select("y", "x", F.lit(True).alias("small"))
    return freq.join(small, ["y", "x"], "left").select("y", "x", F.when(F.col("small").isNull(), F.col("water_freq")).otherwise(0.0).alias("water_freq"))


def clean_water_frequency(freq: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    """Despeckled, without isolated water, blank outside the polygon."""
    done = aoi_mask(remove_isolated_water(despeckle(freq, width), width), vertices)
    return done.select("y", "x", F.when(F.col("in_aoi"), F.col("water_freq")).alias("water_freq"))


def contour_cells(freq: DataFrame, level: float = 0.5) -> DataFrame:
    """2 x 2 cells that the level crosses, by their upper-left pixel, and where it cuts each side (NULL where it doesn't).

    Neighbours are found by position, so a missing pixel leaves its cells out.
    """
    corners = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])
    v = freq.where("water_freq IS NOT NULL").select("y", "x", "water_freq", F.inline(corners))
    at = lambda dy, dx, name: F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("water_freq"))).alias(name)
    cells = v.groupBy((F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x")).agg(at(0, 0, "v00"), at(0, 1, "v01"), at(1, 0, "v10"), at(1, 1, "v11"))
    cells = cells.where("v00 IS NOT NULL AND v01 IS NOT NULL AND v10 IS NOT NULL AND v11 IS NOT NULL")
    low, high = F.least("v00", "v01", "v10", "v11"), F.greatest("v00", "v01", "v10", "v11")
    cut = lambda a, b: F.when((F.col(a) < level) != (F.col(b) < level), (level - F.col(a)) / (F.col(b) - F.col(a)))
    return cells.where((low < level) & (high >= level)).select("y", "x", cut("v00", "v01").alias("top"), cut("v10", "v11").alias("bottom"), cut("v00", "v10").alias("left"), cut("v01", "v11").alias("right"))


def rings(pixels: DataFrame, width: int, store=stored) -> DataFrame:
    """The outline of a pixel set as ordered rings: ring (its least edge), pos, and the corner x, y; outer rings are walked clockwise (y down), holes the other way.

    Every edge knows the next one (where parts touch at a corner, the right turn that stays on its own part). Pointers are
    doubled until each edge has met the least edge of its ring and knows how far ahead it lies: as many rounds as the
    longest ring's length has binary digits, each a join of edges by number, so no ring has to fit into a task.
    """
    e = outline_edges(pixels)
    side = F.when(F.col("x2") > F.col("x1"), 0).when(F.col("y2") > F.col("y1"), 1).when(F.col("x2") < F.col("x1"), 2).otherwise(3)
    e = e.withColumn("id", (F.col("y1").cast("bigint") * (width + 1) + F.col("x1")) * 4 + side)
    ahead = e.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    turn = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y2")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x2"))
    edges = store(e.join(ahead, ["x2", "y2"]).groupBy("id", "x1", "y1").agg(F.max_by("next", turn).alias("next")))
    now = store(edges.select("id", "next", F.col("id").alias("low"), F.lit(0).cast("bigint").alias("far")))
    reach = 1
    while True:
        there = now.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        lower = F.col("low2") < F.col("low")
        then = store(now.join(there, "next").select("id", F.col("after").alias("next"), F.least("low", "low2").alias("low"), F.when(lower, F.col("far2") + reach).otherwise(F.col("far")).alias("far"), lower.alias("moved")))
        reach *= 2
        settled = then.where("moved").isEmpty()
        if store is stored:
            drop_stored(now)
        now = then.drop("moved")
        if settled:
            break
    sizes = now.groupBy("low").agg(F.count("*").alias("n"))
    placed = now.join(sizes, "low").select("id", F.col("low").alias("ring"), F.pmod(F.col("n") - F.col("far"), F.col("n")).alias("pos"))
    return edges.join(placed, "id").select("ring", "pos", F.col("x1").alias("x"), F.col("y1").alias("y"))
