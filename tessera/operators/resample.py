"""Resampling of complex images onto a reference grid, and the loop that folds measured residuals back into the offsets.

A tile of the result reads the lattice nodes around it and the blocks of the image that its shifted cells reach; both come by
equi-joins of the tile's own lists of nodes and blocks, and the tile is one group: of tile ** 2 cells, its halo, and
as much as offsets differ inside the tile. The image as a whole is never in one group, and gross offsets cost no halo.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir

from .blocks import residual_constant
from .fixpoint import cut, discard
from .tiling import cogrouped

#: Taps on either side of a sample.
HALF = 4
BLOCK = 32


@dataclass(frozen=True)
class Lattice:
    """First node's line and sample, and lines and samples between nodes; nodes are counted by row and col from 0."""

    origin: tuple[float, float]
    skip: tuple[float, float]
    shape: tuple[int, int]


def sinc_weights(frac: np.ndarray, half: int = HALF) -> np.ndarray:
    """Weights (2 * half, ...) of the samples from 1 - half to half around a place `frac` behind sample 0: a sinc under a
    squared cosine, scaled to a sum of one."""
    x = frac - np.arange(1 - half, half + 1).reshape(-1, *[1] * np.ndim(frac))
    w = np.sinc(x) * np.cos(np.pi * x / (2 * half)) ** 2
    return w / w.sum(axis=0)


def _field(nodes: pd.DataFrame, lattice: Lattice, r: np.ndarray, c: np.ndarray, value: str) -> np.ndarray:
    """The lattice's bilinear value at lines r and samples c; beyond the outer nodes theirs, and 0 where a node has none."""
    (i0, j0), (h, w) = nodes[["i", "j"]].min(), nodes[["i", "j"]].max() - nodes[["i", "j"]].min() + 1
    a = np.zeros((h, w))
    a[nodes["i"] - i0, nodes["j"] - j0] = nodes[value].to_numpy(float, na_value=0.0)
    axes = []
    for at, first, o, s, n, m in ((r, i0, lattice.origin[0], lattice.skip[0], lattice.shape[0], h), (c, j0, lattice.origin[1], lattice.skip[1], lattice.shape[1], w)):
        t = np.clip((at - o) / s, 0, n - 1) - first
        k = np.clip(np.floor(t).astype(int), 0, max(m - 2, 0))
        axes.append((k, np.minimum(k + 1, m - 1), t - k))
    (a0, a1, y), (b0, b1, x) = axes
    y, x = y[:, None], x[None, :]
    return a[np.ix_(a0, b0)] * (1 - y) * (1 - x) + a[np.ix_(a0, b1)] * (1 - y) * x + a[np.ix_(a1, b0)] * y * (1 - x) + a[np.ix_(a1, b1)] * y * x


def _nodes_of(axis: int, first: Column, last: Column, lattice: Lattice) -> Column:
    """The nodes along an axis that cells from first to last interpolate from."""
    o, s, n = lattice.origin[axis], lattice.skip[axis], lattice.shape[axis]
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (x - o) / s))
    return F.sequence(F.floor(at(first)).cast("int"), F.least(F.lit(n - 1), F.floor(at(last)) + 1).cast("int"))


def resampled_image(image: DataFrame, offsets: DataFrame, lattice: Lattice, shape: tuple[int, int], image_shape: tuple[int, int] | None = None, carrier: float = 0.0, tile: int = 128, half: int = HALF, places: bool = False) -> DataFrame:
    """(row, col, re, im) of the image (row, col, re, im) at (row + az, col + rg), on a grid of the given shape.

    offsets (row, col, az, rg) are those of the lattice's nodes, bilinear between them; missing nodes and null offsets count
    as 0. carrier is the phase a line (radians) that is taken off before and put back after. Missing and null samples
    count as 0, as in the files; cells that reach beyond the image's shape (that of the grid, if not given) have no row.
    With `places`, y and x are the line and sample of the image that a cell shows.
    """
    rows, cols = shape
    own_rows, own_cols = image_shape or shape
    spark = image.sparkSession
    down, across = -(-rows // tile), -(-cols // tile)
    tiles = spark.range(down * across).select(F.expr(f"cast(id div {across} as int)").alias("ty"), (F.col("id") % across).cast("int").alias("tx"))
    r0, c0 = F.col("ty") * tile, F.col("tx") * tile
    r1, c1 = F.least(r0 + tile, F.lit(rows)) - 1, F.least(c0 + tile, F.lit(cols)) - 1
    wanted = tiles.withColumn("i", F.explode(_nodes_of(0, r0, r1, lattice))).withColumn("j", F.explode(_nodes_of(1, c0, c1, lattice)))
    given = offsets.select(F.col("row").alias("i"), F.col("col").alias("j"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in ("az", "rg")])
    shared_dir(spark)
    nodes = cut(wanted.join(given, ["i", "j"], "left").fillna(0.0, ["az", "rg"]))
    spread = nodes.groupBy("ty", "tx").agg(*[f(v).alias(f"{v}{k}") for v in ("az", "rg") for k, f in ((0, F.min), (1, F.max))])
    blocks = lambda low, high: F.sequence(F.floor((low - half) / BLOCK).cast("int"), F.floor((high + half) / BLOCK).cast("int"))
    reached = spread.withColumn("bi", F.explode(blocks(r0 + F.floor("az0"), r1 + F.ceil("az1")))).withColumn("bj", F.explode(blocks(c0 + F.floor("rg0"), c1 + F.ceil("rg1")))).select("ty", "tx", "bi", "bj")
    cells = image.where("re is not null and im is not null").select("row", "col", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"), F.floor(F.col("row") / BLOCK).cast("int").alias("bi"), F.floor(F.col("col") / BLOCK).cast("int").alias("bj"))
    dealt = cells.join(reached, ["bi", "bj"]).drop("bi", "bj")

    def run(at: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(at["ty"].iloc[0]), int(at["tx"].iloc[0])
        r = np.arange(ty * tile, min(rows, (ty + 1) * tile))
        c = np.arange(tx * tile, min(cols, (tx + 1) * tile))
        y = r[:, None] + _field(at, lattice, r, c, "az")
        x = c[None, :] + _field(at, lattice, r, c, "rg")
        i, j = np.floor(y).astype(int) + 1 - half, np.floor(x).astype(int) + 1 - half
        inside = (i >= 0) & (i + 2 * half <= own_rows) & (j >= 0) & (j + 2 * half <= own_cols)
        low, left = (int(k[inside].min()) if inside.any() else 0 for k in (i, j))
        h, w = (int(k[inside].max()) - k0 + 2 * half if inside.any() else 1 for k, k0 in ((i, low), (j, left)))
        a = np.zeros((h, w), complex)
        p, s = own["row"].to_numpy() - low, own["col"].to_numpy() - left
        there = (p >= 0) & (p < h) & (s >= 0) & (s < w)
        a[p[there], s[there]] = ((own["re"].to_numpy() + 1j * own["im"].to_numpy()) * np.exp(-1j * carrier * own["row"].to_numpy()))[there]
        i, j, y, x = i[inside], j[inside], y[inside], x[inside]
        wy, wx = sinc_weights(y - np.floor(y), half), sinc_weights(x - np.floor(x), half)
        out = np.zeros(len(y), complex)
        for k in range(2 * half):
            for m in range(2 * half):
                out += wy[k] * wx[m] * a[i + k - low, j + m - left]
        out *= np.exp(1j * carrier * y)
        rr, cc = np.broadcast_to(r[:, None], inside.shape)[inside], np.broadcast_to(c[None, :], inside.shape)[inside]
        return pd.DataFrame({"row": rr.astype(np.int32), "col": cc.astype(np.int32), "re": out.real, "im": out.imag} | ({"y": y, "x": x} if places else {}))

    return cogrouped(nodes, dealt, ["ty", "tx"], run, "row int, col int, re double, im double" + ", y double, x double" * places)


def add_offsets(offsets: DataFrame, more: DataFrame) -> DataFrame:
    """The sum of two tables of offsets (row, col, az, rg) by node; what one of them doesn't have counts as 0."""
    both = offsets.select("row", "col", "az", "rg").unionByName(more.select("row", "col", "az", "rg"))
    return both.groupBy("row", "col").agg(*[F.sum(F.coalesce(v, F.lit(0.0))).alias(v) for v in ("az", "rg")])


def coregistered(image: DataFrame, offsets: DataFrame, lattice: Lattice, shape: tuple[int, int], measure: Callable[[DataFrame], DataFrame], tolerance: float = 0.02, rounds: int = 5, field: Callable[[DataFrame], DataFrame] | None = None, least: int = 20, **options) -> tuple[DataFrame, DataFrame, list[tuple[float, float, int]]]:
    """(resampled image, offsets in use, residuals (azimuth, range, windows) by round).

    Each round resamples the image as it came, never the round before, with the offsets summed up so far; measure gives
    windows (row, col, azimuth, range) of what is left. Their robust median is added to all nodes until it is below the
    tolerance in both directions; `field`, if given, makes an increment (row, col, az, rg) of its own from the windows of the
    first round and is added instead there. Fewer than `least` windows, or no settling in the rounds, is an error. Every round's
    tables are written, and those of the round before deleted.
    """
    now, seen = cut(offsets.select("row", "col", *[F.col(v).cast("double").alias(v) for v in ("az", "rg")])), []
    for k in range(rounds):
        made = cut(resampled_image(image, now, lattice, shape, **options))
        windows = cut(measure(made))
        # one row each; too few windows raise an error there
        left = [residual_constant(windows.select(F.col(c).alias("v")), least=least).first() for c in ("azimuth", "range")]
        seen.append((float(left[0]["level"]), float(left[1]["level"]), int(left[0]["n"])))
        if max(abs(seen[-1][0]), abs(seen[-1][1])) < tolerance and not (field and k == 0):
            discard(windows)
            return made, now, seen
        if field and k == 0:
            more = field(windows)
        else:
            more = now.select("row", "col", F.lit(seen[-1][0]).alias("az"), F.lit(seen[-1][1]).alias("rg"))
        before, now = now, cut(add_offsets(now, more))
        for old in (before, made, windows):
            discard(old)
    raise RuntimeError(f"the offsets didn't settle in {rounds} rounds: {seen}")
