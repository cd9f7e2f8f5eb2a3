"""Rasters cut into tiles that overlap by a halo, so that work on neighbourhoods has groups of bounded size.

Two forms: tile_arrays packs each tile into one row of dense arrays, for look-ups by columns after a join on the tile, and
by_tiles hands each tile with its halo to a numpy kernel as one group. A cell is copied to the tiles whose halo it lies in,
four at most while the halo is no wider than a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiles_with(axis: str, size: int, halo: int, n: int) -> Column:
    """The tiles along an axis of n cells whose halo holds the cell, as an array."""
    at = F.col(axis)
    low = F.greatest(F.lit(0), F.floor((at - halo) / size))
    return F.sequence(low.cast("int"), F.least(F.lit((n - 1) // size), F.floor((at + halo) / size)).cast("int"))


def dealt(df: DataFrame, shape: tuple[int, int], size: int, halo: int) -> DataFrame:
    """The cells of df (row, col, ...) inside the shape, once for each tile (ty, tx) whose halo they lie in."""
    inside = df.where(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))
    return inside.withColumn("ty", F.explode(tiles_with("row", size, halo, shape[0]))).withColumn("tx", F.explode(tiles_with("col", size, halo, shape[1])))


def tile_arrays(df: DataFrame, shape: tuple[int, int], size: int, halo: int, values: Sequence[str]) -> DataFrame:
    """(ty, tx, r0, c0, w, and an array of each value) of the tiles that hold a cell; arrays are dense, by rows.

    Cells that are missing are null in the arrays; of a cell that comes twice the greatest values are taken. An array has
    (size + 2 * halo) ** 2 values at most.
    """
    rows, cols = shape
    edge = lambda t, n: (F.greatest(F.lit(0), F.col(t) * size - halo), F.least(F.lit(n), (F.col(t) + 1) * size + halo))
    (r0, r1), (c0, c1) = edge("ty", rows), edge("tx", cols)
    cells = dealt(df.select("row", "col", *[F.col(v).cast("double").alias(v) for v in values]), shape, size, halo)
    tiles = cells.select("ty", "tx").distinct().withColumns({"r0": r0.cast("int"), "c0": c0.cast("int"), "h": (r1 - r0).cast("int"), "w": (c1 - c0).cast("int")})
    # every cell of a tile, so that places follow from row and col
    blank = tiles.select("ty", "tx", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("at"))
    own = cells.join(tiles, ["ty", "tx"]).select("ty", "tx", ((F.col("row") - F.col("r0")) * F.col("w") + F.col("col") - F.col("c0")).alias("at"), *values)
    full = blank.select("ty", "tx", "at", *[F.lit(None).cast("double").alias(v) for v in values]).unionByName(own).groupBy("ty", "tx", "at").agg(*[F.max(v).alias(v) for v in values])
    packed = full.groupBy("ty", "tx").agg(F.sort_array(F.collect_list(F.struct("at", *values))).alias("cells"))
    return packed.join(tiles, ["ty", "tx"]).select("ty", "tx", "r0", "c0", "w", *[F.col(f"cells.{v}").alias(v) for v in values])


def at_place(values: Column, row: Column, col: Column, shape: tuple[int, int], prefix: str = "") -> Column:
    """Bilinear value of a tile's array at a place of the whole raster, null where a corner that counts is missing."""
    r = F.greatest(F.lit(0), F.least(F.lit(max(shape[0] - 2, 0)), F.floor(row).cast("int")))
    c = F.greatest(F.lit(0), F.least(F.lit(max(shape[1] - 2, 0)), F.floor(col).cast("int")))
    y, x = row - r, col - c
    first = (r - F.col(f"{prefix}r0")) * F.col(f"{prefix}w") + c - F.col(f"{prefix}c0")
    corner = lambda dr, dc: F.get(values, (first + dr * F.col(f"{prefix}w") + dc).cast("int"))
    part = lambda weight, dr, dc: F.when(weight == 0, F.lit(0.0)).otherwise(weight * corner(dr, dc))
    value = part((1 - y) * (1 - x), 0, 0) + part((1 - y) * x, 0, 1) + part(y * (1 - x), 1, 0) + part(y * x, 1, 1)
    return F.when((row >= 0) & (row <= shape[0] - 1) & (col >= 0) & (col <= shape[1] - 1), value)


def cogrouped(a: DataFrame, b: DataFrame, key: Sequence[str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Groups of a with those of b under one key. b's columns get identities of their own, as both may come from one table."""
    own = b.select(*[F.col(c).alias(c) for c in b.columns])
    return a.groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(run, schema)


def by_tiles(df: DataFrame, shape: tuple[int, int], size: int, halo: int, kernel: Callable[[dict[str, np.ndarray], int, int], dict[str, np.ndarray]], values: Sequence[str], out: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, row, col, out) of a kernel of tiles with their halo, for rasters (by, row, col, values).

    The kernel gets dense arrays of the values, NaN where missing, of the rows and columns from (r0, c0) on, cut at the
    raster's edge, and gives arrays of the same shape, of which the cells of the tile itself are kept; NaN is null. A tile
    is a group of (size + 2 * halo) ** 2 cells at most, whatever the raster's size.
    """
    rows, cols = shape
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        r0, c0 = max(0, ty * size - halo), max(0, tx * size - halo)
        h, w = min(rows, (ty + 1) * size + halo) - r0, min(cols, (tx + 1) * size + halo) - c0
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        dense = {}
        for v in values:
            dense[v] = np.full((h, w), np.nan)
            dense[v][r, c] = pdf[v].to_numpy(float, na_value=np.nan)
        made = kernel(dense, r0, c0)
        a, b = ty * size - r0, tx * size - c0
        own = (slice(a, min(a + size, h)), slice(b, min(b + size, w)))
        y, x = np.mgrid[r0 + own[0].start : r0 + own[0].stop, c0 + own[1].start : c0 + own[1].stop]
        keys = {k: [pdf[k].iloc[0]] * y.size for k in by}
        return pd.DataFrame(keys | {"row": y.ravel().astype(np.int32), "col": x.ravel().astype(np.int32)} | {k: pd.array(made[k][own].ravel(), "Float64") if np.isnan(made[k][own]).any() else made[k][own].ravel() for k in out})

    schema = "".join(f"`{k}` {types[k]}, " for k in by) + "row int, col int, " + ", ".join(f"{k} double" for k in out)
    return dealt(df.select(*by, "row", "col", *values), shape, size, halo).groupBy(*by, "ty", "tx").applyInPandas(run, schema)
