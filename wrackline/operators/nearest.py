"""The nearest node of each target, by descent through a pyramid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.sources.scratch import stored

#: Nodes of a cell that isn't cut further, cells along a side of the cell above, finest level.
LEAF, SIDE, DEPTH = 64, 4, 12
#: Cells that are broadcast at most (some 100 bytes each).
BROADCAST_CELLS = 200_000


def _small(cells: DataFrame, n: int) -> DataFrame:
    return F.broadcast(cells) if n <= BROADCAST_CELLS else cells


def _cell(c: str, size: float, level: int) -> Column:
    """Cells nest exactly: the quotient is multiplied by a power of two only."""
    return F.floor(F.col(c) / size * float(SIDE**level)).cast("bigint")


def _pyramid(nodes: DataFrame, size: float, leaf: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The cells of each level with their number, and every node with the (level, cy, cx) of the cell where cutting stops.

    A cell has the extremes of its nodes, one of them, and their number. Only cells over `leaf` nodes are cut, so that
    dense places get fine cells and empty ones none; the levels end with the densest place.
    """
    rest = stored(nodes.where("node_lat + node_lon BETWEEN -1e9 AND 1e9").distinct(), "nodes")
    levels, leaves = [], None
    for level in range(DEPTH + 1):
        at = rest.withColumns({"cy": _cell("node_lat", size, level), "cx": _cell("node_lon", size, level)})
        cells = at.groupBy("cy", "cx").agg(
            F.min("node_lat").alias("lat0"), F.max("node_lat").alias("lat1"), F.min("node_lon").alias("lon0"), F.max("node_lon").alias("lon1"),
            F.min(F.struct("node_lat", "node_lon")).alias("one"), F.count("*").alias("n"),
        )
        cut = F.col("n") > leaf if level < DEPTH else F.lit(False)
        cells = stored(cells.withColumn("cut", cut), "cells")
        held = cells.agg(F.count("*"), F.count_if("cut")).first()
        levels.append((cells, held[0]))
        done = at.join(_small(cells.where("NOT cut").select("cy", "cx"), held[0] - held[1]), ["cy", "cx"]).select(F.lit(level).alias("level"), "cy", "cx", "node_lat", "node_lon")
        leaves = done if leaves is None else leaves.unionByName(done)
        if not held[1]:
            break
        rest = stored(at.join(_small(cells.where("cut").select("cy", "cx"), held[1]), ["cy", "cx"]).select("node_lat", "node_lon"), "nodes")
    return levels, leaves


def _rank(dy: Column, dx: Column, sizes: list[float]) -> Column:
    """(box, d2): the number of the smallest box that holds the offset, and its square length."""
    far, index = F.greatest(dy, dx), F.lit(len(sizes) - 1)
    for i in reversed(range(len(sizes) - 1)):
        index = F.when(far <= sizes[i], i).otherwise(index)
    return F.struct(index.alias("box"), (dy**2 + dx**2).alias("d2"))


def _promising(rows: DataFrame, sizes: list[float]) -> DataFrame:
    """(target, cell) rows whose cell may hold the target's nearest node: no nearer than `least`, while `best` is a node's rank.

    The same arithmetic on the cell's nearest edge and on nodes rounds the same way, so ties are never lost.
    """
    gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    off = lambda c: F.abs(F.col(f"one.node_{c}") - F.col(c))
    within = lambda a, b: (a <= sizes[-1]) & (b <= sizes[-1])
    rows = rows.where(within(gap("lat"), gap("lon"))).withColumn("least", _rank(gap("lat"), gap("lon"), sizes))
    rows = rows.withColumn("met", F.when(within(off("lat"), off("lon")), _rank(off("lat"), off("lon"), sizes)))
    rows = rows.withColumn("best", F.min(F.least("best", "met")).over(Window.partitionBy("target")))
    return rows.where(F.col("best").isNull() | (F.col("least") <= F.col("best")))


def _surviving(targets: DataFrame, levels: list[tuple[DataFrame, int]], sizes: list[float]) -> DataFrame:
    """(target, lat, lon, level, cy, cx): the last cells that may hold each target's nearest node."""
    none = F.lit(None).cast("struct<box:int,d2:double>")
    kept = ["target", "lat", "lon", "level", "cy", "cx", "least", "best"]
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    front = targets.select("target", "lat", "lon", F.inline(around))
    front = front.withColumns({"py": _cell("lat", sizes[-1], 0) + F.col("a"), "px": _cell("lon", sizes[-1], 0) + F.col("b"), "best": none}).drop("a", "b")
    last = None
    for level, (cells, n) in enumerate(levels):
        above = {"py": F.floor(F.col("cy") / SIDE), "px": F.floor(F.col("cx") / SIDE)} if level else {"py": F.col("cy"), "px": F.col("cx")}
        near = _promising(front.join(_small(cells.withColumns(above), n), ["py", "px"]).withColumn("level", F.lit(level)), sizes)
        if level + 1 < len(levels):
            near = stored(near.select(*kept, "cut"), "front")
            front = near.where("cut").select("target", "lat", "lon", F.col("cy").alias("py"), F.col("cx").alias("px"), "best")
        ends = near.where("NOT cut").select(kept)
        last = ends if last is None else last.unionByName(ends)
    if len(levels) > 1:  # what was left higher up is held against what was met further down
        last = last.withColumn("best", F.min("best").over(Window.partitionBy("target"))).where(F.col("best").isNull() | (F.col("least") <= F.col("best")))
    return last.drop("least", "best")


def nearest(targets: DataFrame, nodes: DataFrame, sizes: list[float], leaf: int = LEAF) -> DataFrame:
    """target, box (index into sizes), d2, node_lat, node_lon: of each target the node of the least (box, d2, lat, lon).

    box is the smallest of the growing boxes, +- sizes[i] degrees, that holds a node. targets: target, lat, lon. nodes: lat,
    lon. Targets without a node in the largest box, or without a place, are left out. A target starts with the nine cells
    of that size around it and meets, level by level, only cells no farther than a node it has already met; it is compared
    with the nodes of the last cells, `leaf` each. So the rows of a target don't grow with the density of the nodes.
    """
    levels, leaves = _pyramid(nodes.select(F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon")), sizes[-1], leaf)
    met = _surviving(targets, levels, sizes).join(leaves, ["level", "cy", "cx"])
    dy, dx = F.abs(F.col("node_lat") - F.col("lat")), F.abs(F.col("node_lon") - F.col("lon"))
    rank = F.struct(_rank(dy, dx, sizes).alias("rank"), "node_lat", "node_lon")
    out = met.where((dy <= sizes[-1]) & (dx <= sizes[-1])).groupBy("target").agg(F.min(rank).alias("m"))
    return out.select("target", "m.rank.box", "m.rank.d2", "m.node_lat", "m.node_lon")
