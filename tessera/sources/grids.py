"""Map grids: nested postings, rasterised outlines, resampling between projections, and cyclic colours."""

from __future__ import annotations

import colorsys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import bilinear, edges, fractional, scatter_mean
from tessera.operators.kernels import utm


@dataclass(frozen=True)
class Grid:
    """Upper left corner, posting, size and projection of a north-up grid with square cells."""

    x0: float
    y0: float
    posting: float
    nx: int
    ny: int
    epsg: int

    def finer(self, posting: float) -> Grid:
        """The same area at a posting that divides this one into whole cells."""
        times = round(self.posting / posting)
        if times < 1 or abs(times * posting - self.posting) > 1e-9 * self.posting:
            raise ValueError(f"a posting of {posting} doesn't divide {self.posting}")
        return Grid(self.x0, self.y0, posting, self.nx * times, self.ny * times, self.epsg)

    def transform(self) -> tuple[float, ...]:
        return (self.x0, self.posting, 0.0, self.y0, 0.0, -self.posting)


def grid_of(transform: tuple[float, ...], nx: int, ny: int, epsg: int | None) -> Grid:
    """The grid of a raster's transform; rotated grids, oblong cells and unknown projections are refused."""
    x0, dx, rx, y0, ry, dy = transform
    if rx or ry:
        raise ValueError("the grid is rotated")
    if abs(dx + dy) > 1e-9 * abs(dx):
        raise ValueError("the cells aren't square")
    if not epsg:
        raise ValueError("the grid has no projection")
    return Grid(x0, y0, dx, nx, ny, epsg)


def touched_cells(polygons: DataFrame, grid: Grid, buffer: float = 0.0, tile: int = 64) -> DataFrame:
    """(row, col) of the cells that a polygon (id, ring) covers or touches, grown by a buffer in map units.

    A cell counts if its centre lies inside or an edge crosses the cell grown by the buffer. Each edge is cut against
    the cells of its own box only, and inside tests run along rows of cells, so work follows outlines and areas.
    """
    e = edges(polygons)
    col = lambda x: (x - grid.x0) / grid.posting
    row = lambda y: (grid.y0 - y) / grid.posting
    b = buffer / grid.posting
    e = e.select("id", col(F.col("x1")).alias("c1"), row(F.col("y1")).alias("r1"), col(F.col("x2")).alias("c2"), row(F.col("y2")).alias("r2"))
    span = lambda u, v, n: F.sequence(F.greatest(F.lit(0), F.floor(F.least(u, v) - b).cast("int")), F.least(F.lit(n - 1), F.floor(F.greatest(u, v) + b).cast("int")))
    inside = lambda u, v, n: (F.greatest(u, v) + b >= 0) & (F.least(u, v) - b < n)
    near = e.where(inside(F.col("r1"), F.col("r2"), grid.ny) & inside(F.col("c1"), F.col("c2"), grid.nx))
    near = near.withColumn("row", F.explode(span(F.col("r1"), F.col("r2"), grid.ny)))
    near = near.withColumn("col", F.explode(span(F.col("c1"), F.col("c2"), grid.nx)))

    def enters(p: str, q: str, lo) -> tuple:
        d = F.col(q) - F.col(p)
        a, z = F.try_divide(lo - b - F.col(p), d), F.try_divide(lo + 1 + b - F.col(p), d)
        within = (F.col(p) >= lo - b) & (F.col(p) <= lo + 1 + b)
        return F.when(d == 0, F.when(within, -1e18).otherwise(1e18)).otherwise(F.least(a, z)), F.when(d == 0, F.when(within, 1e18).otherwise(-1e18)).otherwise(F.greatest(a, z))

    (ra, rz), (ca, cz) = enters("r1", "r2", F.col("row")), enters("c1", "c2", F.col("col"))
    crossed = near.where(F.greatest(ra, ca, F.lit(0.0)) <= F.least(rz, cz, F.lit(1.0))).select("row", "col")
    # centres inside: crossings of each row's centre line, in pairs
    high, low = F.floor(F.greatest("r1", "r2") - 0.5).cast("int"), F.ceil(F.least("r1", "r2") - 0.5).cast("int")
    line = e.where((F.col("r1") != F.col("r2")) & (low <= high)).withColumn("row", F.explode(F.sequence(low, high)))
    at = F.col("row") + 0.5
    line = line.where(((F.col("r1") > at) != (F.col("r2") > at)) & F.col("row").between(0, grid.ny - 1))
    cross = line.withColumn("c", F.col("c1") + (at - F.col("r1")) * (F.col("c2") - F.col("c1")) / (F.col("r2") - F.col("r1")))
    # one array for each row of cells of a polygon, of its crossings
    rows = cross.groupBy("id", "row").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    parts = rows.select("row", F.explode(F.expr("transform(sequence(0, size(cs) - 2, 2), k -> struct(cs[k] as a, cs[k + 1] as b))")).alias("s"))
    first, last = F.greatest(F.lit(0), F.ceil(F.col("s.a") - 0.5).cast("int")), F.least(F.lit(grid.nx - 1), F.floor(F.col("s.b") - 0.5).cast("int"))
    filled = parts.where(first <= last).select("row", F.explode(F.sequence(first, last)).alias("col"))
    return crossed.unionByName(filled).distinct()


def projected(points: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """points (..., lon, lat) with x and y in a transverse Mercator zone, by an Arrow-fed numpy series."""
    fields = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x, y = utm(p["lon"].to_numpy(), p["lat"].to_numpy(), zone, south)
            yield p.assign(x=x, y=y)

    return points.mapInPandas(run, f"{fields}, x double, y double")


def resampled(points: DataFrame, field: DataFrame, src: Grid, order: int = 1) -> DataFrame:
    """(row, col, v) of points (row, col, x, y) from a field (row, col, v) on the grid src.

    order 1 is bilinear where the known weight exceeds 0.99; order 0 takes the cell that holds the point.
    """
    c, r = (F.col("x") - src.x0) / src.posting, (src.y0 - F.col("y")) / src.posting
    inside = points.where((c >= 0) & (c < src.nx) & (r >= 0) & (r < src.ny))
    if order == 0:
        at = inside.select("row", "col", F.floor(r).cast("int").alias("r_"), F.floor(c).cast("int").alias("c_"))
        got = at.join(field.select(F.col("row").alias("r_"), F.col("col").alias("c_"), "v"), ["r_", "c_"], "left").select("row", "col", "v")
    else:
        half = src.posting / 2
        fr = fractional(-F.col("y"), -(src.y0 - half), src.posting, src.ny)
        fc = fractional(F.col("x"), src.x0 + half, src.posting, src.nx)
        # the lookup's own cells are the nodes; points keep their row and col under other names
        renamed = inside.withColumnsRenamed({"row": "p_row", "col": "p_col"})
        got = bilinear(renamed, field, fr, fc, ["p_row", "p_col"], "v", 0.99).withColumnsRenamed({"p_row": "row", "p_col": "col"})
    return points.select("row", "col").join(got, ["row", "col"], "left")


def closed_speckle(cells: DataFrame, shape: tuple[int, int], reach: float = 4.0) -> DataFrame:
    """cells (row, col, v) with the cells of the shape that have none but lie within reach of one: they take the nearest
    value, of equally near ones that of the smallest row, then column.

    Each cell offers its value to the cells around it, a number that the reach sets, and the nearest offer wins in one
    grouping with partial minima; nothing is compared with the whole grid.
    """
    k = int(reach)
    around = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if i * i + j * j <= reach * reach]
    offers = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d")) for i, j in around]))
    dealt = cells.where("v is not null").withColumn("o", offers).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.struct(F.col("o.d").alias("d"), F.col("row").alias("r"), F.col("col").alias("c"), "v").alias("offer"))
    inside = F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1)
    return dealt.where(inside).groupBy("row", "col").agg(F.min("offer").alias("offer")).select("row", "col", F.col("offer.v").alias("v"))


def lattice_to_map(nodes: DataFrame, grid: Grid, reach: float = 4.0) -> DataFrame:
    """(row, col, v, valid) of the cells of a map grid that lattice nodes (x, y, v, valid) or their neighbours reach.

    A cell has the mean of the nodes in it, and cells within reach of one that has the nearest; valid is whether more than half
    of the cell's nodes are. Cells beyond have no row. Nodes without a value count for valid only.
    """
    mean = lambda v: scatter_mean(nodes, grid.x0, grid.y0, grid.posting, -grid.posting, grid.nx, grid.ny, v).select("row", "col", F.col("mean").alias("v"))
    shape = (grid.ny, grid.nx)
    share = closed_speckle(mean("valid"), shape, reach).select("row", "col", (F.col("v") > 0.5).alias("valid"))
    return closed_speckle(mean("v"), shape, reach).join(share, ["row", "col"], "full")


def write_lattice_map(nodes: DataFrame, grid: Grid, path: str, reach: float = 4.0, **options) -> tuple[str, str]:
    """Writes the values and the validity of lattice_to_map as two mosaics, path.vrt and path_valid.vrt, with NaN elsewhere."""
    from .geotiff import write_mosaic

    made = lattice_to_map(nodes, grid, reach)
    for name, v in ((f"{path}.vrt", F.col("v")), (f"{path}_valid.vrt", F.col("valid").cast("double"))):
        write_mosaic(made.select("row", "col", v.alias("v")), name, (grid.ny, grid.nx), grid.transform(), grid.epsg, float("nan"), **options)
    return f"{path}.vrt", f"{path}_valid.vrt"


def cyclic_colours(n: int = 256) -> np.ndarray:
    """n RGB rows in 0..1 once around the hue circle at constant lightness and saturation, for wrapped phase."""
    return np.array([colorsys.hls_to_rgb(k / n, 0.5, 0.9) for k in range(n)])
