"""Lattice geometry of the integral, delay checks of a stack, the domain of a solve, and directions from a cube."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S

from .joins import bilinear, fractional
from .stencil import gradient

LIGHT = 299_792_458.0


def integration_geometry(cols: DataFrame, meta: dict) -> DataFrame:
    """cols (col) with slant, da, dr, ds, kappa and wavelength: the metres of one lattice row and column.

    meta: first (column of node 0 in the image), skip (rows, columns), slant0 and dslant (m), az_spacing (m), speed
    (m/s), prf (Hz), wavelength (m), and for a shell height shell_m above 0 also satellite and ground (distances to the
    earth's centre). ds is da / kappa with a shell, else the platform's travel over a row; kappa is null then.
    """
    skip = meta["skip"]
    slant = meta["slant0"] + (meta["first"] + skip[1] * F.col("col")) * meta["dslant"]
    da = skip[0] * meta["az_spacing"]
    shell = meta.get("shell_m") or 0.0
    out = cols.withColumn("slant", slant)
    kappa = S.pierce_fraction(F.col("slant"), F.lit(meta["satellite"]), F.lit(meta["ground"]), F.lit(shell)) if shell > 0 else F.lit(None).cast("double")
    ds = da / F.col("kappa") if shell > 0 else F.lit(skip[0] * meta["speed"] / meta["prf"])
    return out.withColumn("kappa", kappa).select(*cols.columns, "slant", F.lit(float(da)).alias("da"), F.lit(float(skip[1] * meta["dslant"])).alias("dr"), ds.alias("ds"), "kappa", F.lit(meta["wavelength"]).alias("wavelength"))


def delay_differences(delays: DataFrame, most: float = 1e-6) -> DataFrame:
    """(freq, d, delay, delta, cells) of the frequencies of delays (freq, d, delay, bandwidth) whose dates differ by more
    than `most` metres from the first date; cells counts resolution cells. A frequency with an unknown delay is left out."""
    known = delays.groupBy("freq").agg(F.min_by("delay", "d").alias("ref"), F.min_by("bandwidth", "d").alias("bw"), F.min("delay").alias("lo"), F.max("delay").alias("hi"), F.count_if(F.col("delay").isNull()).alias("unknown"))
    # one row for each frequency
    odd = known.where((F.col("unknown") == 0) & (F.greatest(F.col("hi") - F.col("ref"), F.col("ref") - F.col("lo")) > most))
    delta = F.col("delay") - F.col("ref")
    return delays.join(F.broadcast(odd.select("freq", "ref", "bw")), "freq").select("freq", "d", "delay", delta.alias("delta"), (F.abs(delta) / (LIGHT / (2 * F.col("bw")))).alias("cells"))


def check_delay(delays: DataFrame, most: float = 1e-6) -> None:
    """An error that lists the dates and their cells if the dates of a frequency don't share a delay."""
    # one row for each date of a stack and frequency
    bad = delay_differences(delays, most).orderBy("freq", "d").collect()
    if bad:
        raise ValueError("the dates don't share a delay: " + "; ".join(f"{r.freq} {r.d} {r.delay:.4f} m ({r.cells:.2f} cells)" for r in bad))


def solve_domain(df: DataFrame, mask: str = "valid", phases: tuple[str, ...] = ("phi_a", "phi_d")) -> DataFrame:
    """df with the mask taken from cells without one of the phases, as the unwrapper declined them."""
    known = F.lit(True)
    for p in phases:
        known &= F.col(p).isNotNull() & ~F.isnan(p)
    return df.withColumn(mask, F.coalesce(F.col(mask), F.lit(False)) & known)


def cube_directions(points: DataFrame, cube: DataFrame, axes: tuple[float, float, int, float, float, int], cell: float) -> DataFrame:
    """(row, col, az, rg, inc, az_x, az_y, rg_x, rg_y) of points (row, col, x, y), a full grid of square cells.

    cube (row, col, az, rg, inc) has nodes at x0 + col * dx and y0 + row * dy; axes are (x0, dx, nx, y0, dy, ny). Values
    are linear between nodes and go on linearly beyond them. Directions are unit vectors of the gradients, x along
    columns and y against rows; where a gradient is 0 they are 0.
    """
    x0, dx, nx, y0, dy, ny = axes
    fr, fc = fractional(F.col("y"), y0, dy, ny, False), fractional(F.col("x"), x0, dx, nx, False)
    at = points.withColumnsRenamed({"row": "p_row", "col": "p_col"})
    out = points.select("row", "col")
    for name in ("az", "rg", "inc"):
        got = bilinear(at, cube, fr, fc, ["p_row", "p_col"], name).withColumnsRenamed({"p_row": "row", "p_col": "col"})
        out = out.join(got, ["row", "col"], "left")
    for name in ("az", "rg"):
        for axis in ("row", "col"):
            out = gradient(out, name, axis).withColumnRenamed("slope", f"{name}_{axis}")
        vx, vy = F.col(f"{name}_col") / cell, -F.col(f"{name}_row") / cell
        n = F.sqrt(vx * vx + vy * vy)
        n = F.when(n > 0, n).otherwise(1.0)
        out = out.withColumns({f"{name}_x": vx / n, f"{name}_y": vy / n}).drop(f"{name}_row", f"{name}_col")
    return out


def state_or_zero(cells: DataFrame, state: DataFrame | None, shape: tuple[int, int]) -> DataFrame:
    """(row, col, v) of what an earlier pass applied to cells (row, col), 0 where it has none or a state of another shape."""
    zero = cells.select("row", "col").withColumn("v", F.lit(0.0))
    if state is None:
        return zero
    # one row
    size = state.agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c")).first()
    if (size.r, size.c) != tuple(shape):
        return zero
    return cells.select("row", "col").join(state.select("row", "col", "v"), ["row", "col"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
