"""Joins by position, interval and area."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after they are counted.
BROADCAST_ROWS = 1_000_000
#: Nodes of an axis that every point may be compared with.
FEW_NODES = 1000
#: Rows of a range of positions, which one task sorts, and the most ranges.
RANGE_ROWS = 100_000
MOST_RANGES = 4096


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; else Spark chooses."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fractional(x: Column, origin, step, n: int, clamp: bool = True) -> tuple[Column, Column]:
    """(lower node, weight of the upper one) of a position on an axis of n nodes; the edge is held if clamped."""
    t = (x - origin) / step
    if clamp:
        t = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), t))
    low = F.greatest(F.lit(0), F.least(F.floor(t).cast("int"), F.lit(n - 2)))
    return low, t - low


def bilinear(points: DataFrame, grid: DataFrame, row: tuple[Column, Column], col: tuple[Column, Column], key: Sequence[str], value: str = "v", valid: float | None = None) -> DataFrame:
    """points' key columns with value: the weighted sum of the four nodes of grid (row, col, value) around each point.

    A node without a value and with weight makes the result null; with `valid` the nodes that have one are averaged
    if their weights exceed it. Each point sends four weighted keys to one equi-join.
    """
    (i, wi), (j, wj) = row, col
    corner = lambda r, c: F.struct((i + r).alias("row"), (j + c).alias("col"), ((wi if r else 1 - wi) * (wj if c else 1 - wj)).alias("w"))
    sent = points.select(*key, F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("c")).select(*key, "c.row", "c.col", "c.w").where("w <> 0")
    got = sent.join(grid.select("row", "col", value), ["row", "col"], "left")
    known = F.sum(F.when(F.col(value).isNotNull(), F.col("w")).otherwise(0.0))
    total = F.sum(F.col("w") * F.col(value))
    out = got.groupBy(*key).agg(total.alias("s_"), known.alias("k_"), F.sum("w").alias("w_"))
    ok = F.col("k_") > valid if valid is not None else F.abs(F.col("k_") - F.col("w_")) < 1e-12
    return out.select(*key, F.when(ok, F.col("s_") / (F.col("k_") if valid is not None else F.lit(1.0))).alias(value))


def bracket(points: DataFrame, axis: DataFrame, x: str, ax: str = "x", ay: str = "y", few: int = FEW_NODES) -> DataFrame:
    """points with y: the piecewise linear axis table (x, y) at the points' x, its ends held.

    The axis becomes intervals [x, next x). Up to `few` of them are broadcast to a range join; a longer axis is met by
    ranges of positions (see _neighbours).
    """
    nodes = axis.select(F.col(ax).cast("double").alias("x0"), F.col(ay).alias("y0")).where("x0 is not null")
    ends = nodes.agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"))
    p = points.crossJoin(F.broadcast(ends)).withColumn("t_", F.greatest("lo", F.least("hi", F.col(x).cast("double")))).drop("lo", "hi")
    if nodes.limit(few + 1).count() <= few:
        w = W.orderBy("x0", "y0")  # at most `few` rows
        seg = nodes.select("x0", "y0", F.lead("x0").over(w).alias("x1"), F.lead("y0").over(w).alias("y1"))
        out = p.join(F.broadcast(seg), (F.col("t_") >= F.col("x0")) & ((F.col("t_") < F.col("x1")) | F.col("x1").isNull()))
    else:
        # many points may share a place, which only the join meets; estimates from file sizes would broadcast it
        out = p.join(_neighbours(p.select("t_").distinct(), nodes).hint("merge"), "t_")
    out = out.withColumn("y", F.col("y0") + F.coalesce(F.try_divide((F.col("t_") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("x1") - F.col("x0")), F.lit(0.0)))
    return out.drop("t_", "x0", "x1", "y0", "y1")


def _neighbours(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(t_, x0, y0, x1, y1): the last node (x0, y0) at or below each place t_, and the first one above it.

    Nodes and places are dealt to ranges of about RANGE_ROWS rows and sorted there; the nodes next to a range come from
    a table with one row for each range. Approximate quantiles bound the ranges, so they decide the balance only.
    """
    node = F.struct("x0", "y0")
    rows = nodes.select(F.col("x0").alias("t_"), node.alias("node")).unionByName(places.where("t_ is not null"), allowMissingColumns=True)
    n = min(rows.count() // RANGE_ROWS + 1, MOST_RANGES)
    bounds = sorted({b for b in rows.approxQuantile("t_", [k / n for k in range(1, n)], 0.25 / n) if math.isfinite(b)}) if n > 1 else []
    if bounds:
        rows = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="t_", outputCol="r_", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("r_", F.lit(0.0))
    w = W.orderBy("r_")  # one row for each range
    near = rows.groupBy("r_").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    near = near.select("r_", F.max("z").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.min("a").over(w.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    # a node stands before the places that equal it, from below and from above
    up = W.partitionBy("r_").orderBy("t_", F.col("node").isNull(), "node").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("r_").orderBy(F.desc("t_"), F.desc(F.col("node").isNull()), F.desc("node")).rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("r_", "t_", "node", F.last("node", True).over(up).alias("low"), F.last("node", True).over(down).alias("high")).where("node is null")
    out = out.join(F.broadcast(near), "r_").select("t_", F.coalesce("low", "before").alias("low"), F.coalesce("high", "after").alias("high")).where("low is not null")
    return out.select("t_", "low.x0", "low.y0", F.col("high.x0").alias("x1"), F.col("high.y0").alias("y1"))


def scatter_mean(points: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, value: str = "v") -> DataFrame:
    """(row, col, mean, n) of the points (x, y, value) in each cell; indices are cut towards zero, then bounds hold."""
    toward = lambda t: F.when(t >= 0, F.floor(t)).otherwise(F.ceil(t)).cast("int")
    cells = points.where(F.col(value).isNotNull()).select(toward((F.col("y") - y0) / dy).alias("row"), toward((F.col("x") - x0) / dx).alias("col"), value)
    return cells.where(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1)).groupBy("row", "col").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def edges(polygons: DataFrame) -> DataFrame:
    """(id, x1, y1, x2, y2) of polygons (id, ring), closed."""
    e = polygons.select("id", F.explode(F.expr("transform(sequence(1, size(ring)), k -> struct(ring[k - 1] as a, ring[k % size(ring)] as b))")).alias("e"))
    return e.select("id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: Sequence[str], size: float) -> DataFrame:
    """(key, id) of each point inside each polygon, by ray casting.

    Polygons are dealt to the tiles of edge `size` that their boxes meet; points join on their tile, then on the box.
    """
    e = edges(polygons)
    box = e.groupBy("id").agg(*[f(c).alias(n) for n, f, c in (("bx0", F.min, "x1"), ("bx1", F.max, "x1"), ("by0", F.min, "y1"), ("by1", F.max, "y1"))])
    tile = lambda c: F.floor(c / size)
    box = box.withColumn("tx", F.explode(F.sequence(tile(F.col("bx0")), tile(F.col("bx1"))))).withColumn("ty", F.explode(F.sequence(tile(F.col("by0")), tile(F.col("by1")))))
    near = points.withColumn("tx", tile(F.col("x"))).withColumn("ty", tile(F.col("y"))).join(box, ["tx", "ty"]).where(F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1")))
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("y") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = near.select(*key, "id", "x", "y").join(e, "id").groupBy(*key, "id").agg(F.sum(F.when(cross, 1).otherwise(0)).alias("k"))
    return hits.where("k % 2 = 1").drop("k")


def aligned(grids: DataFrame, dx: float, dy: float, look_rows: int, look_cols: int) -> DataFrame:
    """grids (d, x0, y0, nx, ny) with whole-cell offsets into the overlap, snapped up to whole looks, and its size.

    Origins further than 0.01 cells from a common lattice, and grids without an overlap, raise an error.
    """
    first = grids.agg(F.min("x0").alias("rx"), F.max("y0").alias("ry"))
    g = grids.crossJoin(F.broadcast(first)).withColumn("fx", (F.col("x0") - F.col("rx")) / dx).withColumn("fy", (F.col("ry") - F.col("y0")) / dy)
    g = g.withColumn("kx", F.rint("fx").cast("int")).withColumn("ky", F.rint("fy").cast("int"))
    off = F.greatest(F.abs(F.col("fx") - F.col("kx")), F.abs(F.col("fy") - F.col("ky")))
    g = g.withColumn("kx", F.when(off <= 0.01, F.col("kx")).otherwise(F.raise_error(F.lit("grids are not on one lattice")).cast("int")))
    up = lambda c, n: (F.ceil(c / n) * n).cast("int")
    over = g.agg(up(F.max("kx"), look_cols).alias("cx"), up(F.max("ky"), look_rows).alias("cy"), F.min(F.col("kx") + F.col("nx")).alias("ex"), F.min(F.col("ky") + F.col("ny")).alias("ey"))
    over = over.select("cx", "cy", F.expr(f"(ex - cx) div {look_cols} * {look_cols}").cast("int").alias("cols"), F.expr(f"(ey - cy) div {look_rows} * {look_rows}").cast("int").alias("rows"))
    over = over.withColumn("cols", F.when((F.col("cols") > 0) & (F.col("rows") > 0), F.col("cols")).otherwise(F.raise_error(F.lit("grids do not overlap")).cast("int")))
    return g.crossJoin(F.broadcast(over)).select("d", (F.col("cx") - F.col("kx")).alias("off_col"), (F.col("cy") - F.col("ky")).alias("off_row"), "rows", "cols")


def missing(wanted: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    return wanted.join(found, list(key), "left_anti")


def water_cells(cells: DataFrame, cover: DataFrame) -> DataFrame:
    """cells (row, col) with water: land cover class 80, class 0, or no cover at all."""
    return cells.join(cover.select("row", "col", "class"), ["row", "col"], "left").withColumn("water", F.coalesce(F.col("class").isin(0, 80), F.lit(True)))
