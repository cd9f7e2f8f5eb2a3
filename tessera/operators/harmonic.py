"""Harmonic fill of large grids by overlapping tiles: every tile with a halo is solved by itself, in turn with the others.

The solution of the graph Laplacian on a tile with its halo, with the halo's rim held at the values of the round before, is one
group. Rounds over all tiles that hold holes converge to the solution of the whole grid, as its fixed point satisfies
every cell's equation; they start from the solution of a coarser grid of block means, found in the same way, so that what the
rounds have to carry over large holes is small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import cut, discard
from .kernels import graph_fill
from .tiling import dealt

#: Cells of a block of the coarser grid, along each axis.
COARSE = 4


def _solve(y: np.ndarray, rim: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The harmonic values of y's holes (NaN), with the rim held at what it is now."""
    held = np.where(np.isnan(y) & rim, now, y)
    return graph_fill(held, iterations=20_000, tol=1e-10)


def _round(state: DataFrame, shape: tuple[int, int], tile: int, halo: int) -> DataFrame:
    """(row, col, v, fixed, moved) after one solution of every tile that holds a hole."""
    rows, cols = shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        r0, c0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
        h, w = min(rows, (ty + 1) * tile + halo) - r0, min(cols, (tx + 1) * tile + halo) - c0
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        now, fixed = np.full((h, w), np.nan), np.zeros((h, w), bool)
        now[r, c], fixed[r, c] = pdf["v"].to_numpy(), pdf["fixed"].to_numpy()
        rim = np.zeros((h, w), bool)
        # where the box ends inside the grid
        rim[0] |= r0 > 0
        rim[-1] |= r0 + h < rows
        rim[:, 0] |= c0 > 0
        rim[:, -1] |= c0 + w < cols
        made = _solve(np.where(fixed, now, np.nan), rim, now)
        own = (r >= ty * tile - r0) & (r < (ty + 1) * tile - r0) & (c >= tx * tile - c0) & (c < (tx + 1) * tile - c0)
        r, c = r[own], c[own]
        return pd.DataFrame({"row": (r + r0).astype(np.int32), "col": (c + c0).astype(np.int32), "v": made[r, c], "fixed": fixed[r, c], "moved": np.abs(made[r, c] - now[r, c])})

    at = lambda axis: F.floor(F.col(axis) / tile).cast("int")
    # tiles are few, one for tile * tile cells
    open_ = F.broadcast(state.where("not fixed").select(at("row").alias("oy"), at("col").alias("ox")).distinct())
    boxes = dealt(state.select("row", "col", "v", "fixed"), shape, tile, halo).join(open_, (F.col("ty") == F.col("oy")) & (F.col("tx") == F.col("ox")), "left_semi")
    solved = boxes.groupBy("ty", "tx").applyInPandas(run, "row int, col int, v double, fixed boolean, moved double")
    rest = state.join(open_, (at("row") == F.col("oy")) & (at("col") == F.col("ox")), "left_anti")
    return solved.unionByName(rest.select("row", "col", "v", "fixed", F.lit(0.0).alias("moved")))


def harmonic_fill(grid: DataFrame, shape: tuple[int, int], tile: int = 128, halo: int = 32, tolerance: float = 1e-7, rounds: int = 400) -> DataFrame:
    """(row, col, v) of every cell of the shape: the known cells of grid (row, col, v), and in the others the values of which
    each is the mean of its neighbours along rows and columns.

    The tolerance, times the spread of the known values, is the most that a cell may move in the last round. A grid of up to a tile is
    solved at once; without a known cell all stay null; rounds that don't settle are an error. Every round is written and
    the one before deleted.
    """
    rows, cols = shape
    spark = grid.sparkSession
    known = grid.where("v is not null").where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy("row", "col").agg(F.max("v").alias("v"))
    low, high = known.agg(F.min("v"), F.max("v")).first()
    every = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    if low is None:
        return every.withColumn("v", F.lit(None).cast("double"))
    whole = every.join(known, ["row", "col"], "left")
    if rows <= tile + 2 * halo and cols <= tile + 2 * halo:
        start = whole.select("row", "col", F.coalesce("v", F.lit(low)).alias("v"), F.col("v").isNotNull().alias("fixed"))
        return _round(start, shape, max(rows, cols), 0).select("row", "col", "v")
    block = lambda axis: F.floor(F.col(axis) / COARSE).cast("int").alias(axis)
    means = known.groupBy(block("row"), block("col")).agg(F.avg("v").alias("v"))
    coarse = harmonic_fill(means, (math.ceil(rows / COARSE), math.ceil(cols / COARSE)), tile, halo, max(tolerance, 1e-4), rounds)
    guess = coarse.select(F.col("row").alias("gr"), F.col("col").alias("gc"), F.col("v").alias("guess"))
    start = whole.join(guess, (F.floor(F.col("row") / COARSE) == F.col("gr")) & (F.floor(F.col("col") / COARSE) == F.col("gc")))
    now = cut(start.select("row", "col", F.coalesce("v", "guess").alias("v"), F.col("v").isNotNull().alias("fixed")))
    for _ in range(rounds):
        before, now = now, cut(_round(now, shape, tile, halo))
        discard(before)
        if now.agg(F.max("moved")).first()[0] <= tolerance * max(high - low, 1e-300):
            return now.select("row", "col", "v")
    raise RuntimeError(f"the fill didn't settle in {rounds} rounds")
