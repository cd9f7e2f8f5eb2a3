"""The interferogram of two granules: geometric offsets, resampling, flattening, looks, filter and map, stage by stage."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import orbits as O
from tessera.operators.blocks import multilook
from tessera.operators.patches import patch_filtered
from tessera.operators.resample import Lattice, resampled_image
from tessera.sources.granule import read_granules
from tessera.sources.provenance import Stages, files_fingerprint, table_fingerprint


@dataclass(frozen=True)
class Options:
    """Of an interferogram. skip: lines and samples between the nodes at which offsets are computed; carrier: phase a line of the
    second image (radians); height: metres of the ground where no height model is given."""

    frequency: str = "A"
    polarization: str = "HH"
    skip: tuple[int, int] = (64, 64)
    carrier: float = 0.0
    height: float = 0.0
    looks: tuple[int, int] = (24, 16)
    alpha: float = 0.5
    nfft: int = 32
    tile: int = 128


def lattice_over(grid: O.RadarGrid, skip: tuple[int, int]) -> Lattice:
    """Nodes from the first cell on that reach the last one."""
    return Lattice((0.0, 0.0), (float(skip[0]), float(skip[1])), (-(-(grid.rows - 1) // skip[0]) + 1, -(-(grid.cols - 1) // skip[1]) + 1))


def geometric_offsets(spark: SparkSession, ref: O.RadarGrid, ref_states: DataFrame, sec: O.RadarGrid, sec_states: DataFrame, lattice: Lattice, surface: float | O.Heights) -> DataFrame:
    """(row, col, az, rg) by node: where the second radar sees the ground that the first one shows there, less the place.

    Nodes whose ground or place isn't known are null.
    """
    down, across = lattice.shape
    nodes = spark.range(down * across).select(F.expr(f"cast(id div {across} as int)").alias("i"), (F.col("id") % across).cast("int").alias("j"))
    points = nodes.select("i", "j", (F.col("i") * lattice.skip[0] + lattice.origin[0]).alias("row"), (F.col("j") * lattice.skip[1] + lattice.origin[1]).alias("col"))
    ground = O.forward(points, ref_states, ref, surface).select("i", "j", "row", "col", *O.XYZ)
    seen = O.inverse(ground, sec_states, sec)
    return seen.select(F.col("i").alias("row"), F.col("j").alias("col"), (F.col("az") - F.col("row")).alias("az"), (F.col("rg") - F.col("col")).alias("rg"))


def flattened(ref: DataFrame, sec: DataFrame, ref_grid: O.RadarGrid, sec_grid: O.RadarGrid, wavelength: float) -> DataFrame:
    """(row, col, r_re, r_im, s_re, s_im): the images on one grid, the second one turned by the difference of their ranges.
    sec (row, col, re, im, x) has the sample of the second image that a cell shows."""
    more = (sec_grid.starting_range + F.col("x") * sec_grid.range_spacing) - (ref_grid.starting_range + F.col("col") * ref_grid.range_spacing)
    turn = F.lit(4 * math.pi / wavelength) * more
    turned = sec.select("row", "col", (F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)).alias("s_re"), (F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)).alias("s_im"))
    return ref.select("row", "col", F.col("re").cast("double").alias("r_re"), F.col("im").cast("double").alias("r_im")).join(turned, ["row", "col"])


def interferogram(spark: SparkSession, ref_path: str, sec_path: str, out: str, options: Options = Options(), heights: O.Heights | None = None, cells: DataFrame | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str, bool]]]:  # noqa: B008
    """(tables by stage, log of (stage, digest, reused)) of the interferogram of two granules, kept below `out`.

    Stages: offsets (row, col, az, rg), resampled (row, col, re, im, y, x), looks (row, col, z_re, z_im, p1, p2, coh), filtered (row, col,
    re, im, coh) and, with map cells (lon, lat, height, ...), map (cells with re, im). Each stage's table is reused as
    long as the granules' files, its own options and the stages before it are the same (see Stages).
    """
    o = asdict(options)
    own = {"frequency": options.frequency, "polarization": options.polarization}
    stages, made = Stages(spark, out), {}
    files = [f"{files_fingerprint(p)} {own}" for p in (ref_path, sec_path)]
    read = lambda path, table, **window: read_granules(spark, path, table, **own, **window)
    radar = [read(p, "radar").first() for p in (ref_path, sec_path)]
    ref, sec = (O.RadarGrid(r.sensing_start, r.prf, r.starting_range, r.range_spacing, r.lookside, r.rows, r.cols) for r in radar)
    lattice = lattice_over(ref, options.skip)
    ground = [table_fingerprint(heights.cells), heights.lon, heights.lat, heights.dx, heights.dy] if heights else [options.height]
    made["offsets"], at = stages("offsets", {"skip": o["skip"], "ground": ground}, files, lambda: geometric_offsets(spark, ref, read(ref_path, "orbit"), sec, read(sec_path, "orbit"), lattice, heights or options.height))
    made["resampled"], at = stages("resampled", {"carrier": o["carrier"]}, [at, files[1]], lambda: resampled_image(read(sec_path, "samples"), made["offsets"], lattice, (ref.rows, ref.cols), (sec.rows, sec.cols), options.carrier, options.tile, places=True))
    made["looks"], at = stages("looks", {"looks": o["looks"]}, [at, files[0]], lambda: multilook(flattened(read(ref_path, "samples"), made["resampled"], ref, sec, radar[0].wavelength), options.looks, (ref.rows, ref.cols)))
    looked = ref.looked(options.looks)
    image = made["looks"].select("row", "col", F.col("z_re").alias("re"), F.col("z_im").alias("im"))
    made["filtered"], at = stages("filtered", {"alpha": o["alpha"], "nfft": o["nfft"]}, [at], lambda: patch_filtered(image, (looked.rows, looked.cols), options.alpha, options.nfft))
    if cells is not None:
        window = lambda rows, cols: made["filtered"].where(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))
        made["map"], at = stages("map", {"cells": table_fingerprint(cells)}, [at, files[0]], lambda: O.geocoded(cells, window, read(ref_path, "orbit"), looked, ["re", "im"]))
    return made, stages.log
