"""Bounded iterations: every round is a plan whose result is written to the shared folder before the next reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import shared_dir

from .robust import least_squares3
from .selection import median
from .stencil import neighbours


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, from a table in the shared folder that outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/tessera/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that cut() made, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/round-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def until_settled(df: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], int], rounds: int, passes: bool = False) -> DataFrame:
    """df after rounds of step until nothing changes. With `passes` the number of rounds is part of the operator and the
    last one is the result; else a loop that hasn't settled by then is an error."""
    now = cut(df)
    for _ in range(rounds):
        before, now = now, cut(step(now))
        discard(before)
        if not changed(now):
            return now
    if not passes:
        raise RuntimeError(f"nothing settled in {rounds} rounds")
    return now


def label_components(cells: DataFrame, cols: int, rounds: int = 60) -> DataFrame:
    """cells (row, col) with label: the smallest row * cols + col of their 4-connected component.

    Each round takes the least label of a cell and its neighbours and then jumps to the label of that label's cell,
    so the number of rounds grows with the logarithm of the longest path.
    """
    own = F.col("row").cast("long") * cols + F.col("col")
    start = cells.select("row", "col", own.alias("label"), F.lit(1).alias("moved"))
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])

    def step(now: DataFrame) -> DataFrame:
        sent = now.select("row", "col", "label", F.explode(around).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "label")
        least = sent.groupBy("row", "col").agg(F.min("label").alias("least"))
        near = now.join(least, ["row", "col"]).withColumn("least", F.least("least", "label"))
        roots = near.select((F.col("row").cast("long") * cols + F.col("col")).alias("at_"), F.col("least").alias("root_"))
        out = near.join(roots, F.col("least") == F.col("at_"), "left").withColumn("new", F.least("least", "root_"))
        return out.select("row", "col", F.col("new").alias("label"), (F.col("new") < F.col("label")).cast("int").alias("moved"))

    return until_settled(start, step, lambda x: x.where("moved = 1").limit(1).count(), rounds).select("row", "col", "label")


def grid_cells(spark, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), F.expr(f"cast(id % {cols} as int)").alias("col"))


def grow(grid: DataFrame, how: str = "mean", holes: DataFrame | None = None, rounds: int = 500) -> DataFrame:
    """grid (row, col, v) with holes filled from their 3 x 3 neighbours, ring by ring, and the flag filled.

    how: mean or median. holes limits the cells that may be filled. Ends when no ring adds a cell, and fails if that takes
    more than `rounds` rings; cells outside the grid have no value and nothing wraps around.
    """
    may = grid.select("row", "col", "v", F.lit(False).alias("filled"))
    may = may.join(holes.select("row", "col", F.lit(True).alias("hole")), ["row", "col"], "left").withColumn("hole", F.coalesce("hole", F.lit(False))) if holes is not None else may.withColumn("hole", F.col("v").isNull())
    may = may.withColumn("moved", F.lit(1))

    def step(now: DataFrame) -> DataFrame:
        near = neighbours(now, 1, True, median=how == "median").drop("count")
        out = now.join(near, ["row", "col"], "left")
        new = F.col("v").isNull() & F.col("hole") & F.col("near").isNotNull()
        return out.select("row", "col", F.when(new, F.col("near")).otherwise(F.col("v")).alias("v"), (F.col("filled") | new).alias("filled"), "hole", new.cast("int").alias("moved"))

    return until_settled(may, step, lambda x: x.where("moved = 1").limit(1).count(), rounds).select("row", "col", "v", "filled")


def fill_interior(grid: DataFrame, rows: int, cols: int, rounds: int = 500) -> DataFrame:
    """Grows means into the holes that don't touch the border; other holes stay empty."""
    labels = label_components(grid.where("v is null").select("row", "col"), cols)
    border = labels.where((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1)).select("label").distinct()
    return grow(grid, holes=labels.join(border, "label", "left_anti"), rounds=rounds)


def nearest(grid: DataFrame, da: float = 1.0, dr: float = 1.0, reach: float | None = None) -> DataFrame:
    """grid (row, col, v) with dist and near_row, near_col, near_v of the nearest cell that has a value.

    Distances are Euclidean with spacing (da, dr); among equals the smallest row, then column wins. The first pass
    finds the nearest value of each column by ignore-nulls frames; the second joins the cells of a row whose column
    distance can win: within the cell's own vertical distance, and within reach if given.
    """
    w = W.partitionBy("col").orderBy("row")
    at = F.when(F.col("v").isNotNull(), F.col("row"))
    up = F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(at, True).over(w.rowsBetween(0, W.unboundedFollowing))
    rows = grid.select("row", "col", "v", up.alias("up"), down.alias("down"))
    col_best = rows.withColumn("src", F.when(F.col("down").isNull() | (F.col("row") - F.col("up") <= F.col("down") - F.col("row")), F.col("up")).otherwise(F.col("down")))
    known = col_best.where(F.col("src").isNotNull()).select("row", F.col("col").alias("c2"), F.col("src").alias("near_row"), (F.pow((F.col("src") - F.col("row")) * da, 2)).alias("v2"))
    own = rows.where("v is not null").select("row", "col", "v", F.lit(0.0).alias("d2"), F.col("row").alias("near_row"), F.col("col").alias("near_col"))
    holes = rows.where("v is null").select("row", "col", "v")
    pairs = holes.join(known, "row").withColumn("d2", F.col("v2") + F.pow((F.col("c2") - F.col("col")) * dr, 2))
    if reach is not None:
        pairs = pairs.where(F.col("d2") <= reach * reach)
    best = pairs.groupBy("row", "col").agg(F.min(F.struct(F.col("d2"), F.col("near_row"), F.col("c2").alias("near_col"))).alias("b")).select("row", "col", "b.*")
    found = holes.join(best, ["row", "col"], "left").select("row", "col", "v", "d2", "near_row", "near_col").unionByName(own)
    values = grid.where("v is not null").select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("v").alias("near_v"))
    return found.join(values, ["near_row", "near_col"], "left").select("row", "col", "v", F.sqrt("d2").alias("dist"), "near_row", "near_col", "near_v")


def despike(lattice: DataFrame, channels: Sequence[str], limit: float, reach: int = 3, least: int = 3, rounds: int = 4) -> DataFrame:
    """lattice (row, col, channels) with keep: cells off their neighbours' median go, pass by pass, at most four times.

    A cell that an earlier channel drops is gone for the later channels of the same pass.
    """
    from .stencil import spikes

    now = lattice.select("row", "col", *channels, F.lit(True).alias("keep"), F.lit(1).alias("moved"))

    def step(df: DataFrame) -> DataFrame:
        out = df.withColumn("before_", F.col("keep"))
        for c in channels:
            kept = out.where("keep").select("row", "col", F.col(c).alias("v"))
            bad = spikes(kept, limit, reach, least).where("spike").select("row", "col", F.lit(True).alias("bad_"))
            out = out.join(bad, ["row", "col"], "left").withColumn("keep", F.col("keep") & F.col("bad_").isNull()).drop("bad_")
        return out.withColumn("moved", (F.col("keep") != F.col("before_")).cast("int")).drop("before_")

    return until_settled(now, step, lambda x: x.where("moved = 1").limit(1).count(), rounds, passes=True).drop("moved")


def relax(grid: DataFrame, tolerance: float = 1e-6, rounds: int = 20_000, each: int = 12) -> DataFrame:
    """grid (row, col, v, fixed) after Jacobi rounds of the 4-neighbour mean in the cells that aren't fixed.

    Ends when no cell has changed by more than the tolerance in `each` rounds, and fails if that takes too long.
    """
    sides = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    own = (F.col("o.dr") == 0) & (F.col("o.dc") == 0)

    def once(now: DataFrame) -> DataFrame:
        # a cell sends itself too, so a round is one aggregate over one reading of the cells
        sent = now.select("*", F.explode(sides).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.when(own, F.struct("v", "fixed", "old")).alias("own"), F.when(~own, F.col("v")).alias("near"))
        met = sent.groupBy("row", "col").agg(F.max("own").alias("own"), F.avg("near").alias("m_")).where("own is not null")
        return met.select("row", "col", F.when(F.col("own.fixed"), F.col("own.v")).otherwise(F.coalesce("m_", "own.v")).alias("v"), "own.fixed", "own.old")

    def step(now: DataFrame) -> DataFrame:
        now = now.select("row", "col", "v", "fixed", F.col("v").alias("old"))
        for _ in range(each):
            now = once(now)
        return now.withColumn("moved", F.abs(F.col("v") - F.col("old")) > tolerance)

    start = grid.select("row", "col", "v", "fixed", F.col("v").alias("old"), F.lit(True).alias("moved"))
    return until_settled(start, step, lambda x: x.where("moved").limit(1).count(), -(-rounds // each)).select("row", "col", "v", "fixed")


def robust_plane(grid: DataFrame, rounds: int = 3) -> DataFrame:
    """grid (row, col, v) with fit: a plane by reweighted least squares; filled has v, or fit in holes."""
    known = grid.where("v is not null").withColumn("w", F.lit(1.0))
    terms = [F.lit(1.0), F.col("row").cast("double"), F.col("col").cast("double")]
    value = F.col("c0") + F.col("c1") * F.col("row") + F.col("c2") * F.col("col")
    fit = None
    for _ in range(rounds):
        fit = least_squares3(known, terms, F.col("v"), F.col("w"))
        resid = known.select("row", "col", "v").crossJoin(F.broadcast(fit)).withColumn("r", F.col("v") - value)
        mid = median(resid, "r")
        wide = median(resid, F.abs(F.col("r") - F.lit(mid)))
        mad = max(1.4826 * wide, 1e-12) if wide is not None else None
        known = cut(resid.select("row", "col", "v", (1 / F.sqrt(1 + F.pow(F.col("r") / (4.685 * F.lit(mad)), 2))).alias("w")))
    out = grid.crossJoin(F.broadcast(fit)).withColumn("fit", value).drop("c0", "c1", "c2")
    return out.withColumn("filled", F.coalesce("v", "fit"))


def regional_level(grid: DataFrame, rows: int, cols: int, levels: int = 9, least: float = 0.02) -> DataFrame:
    """grid (row, col, v) with level: a mean pyramid read from coarse to fine, each level as far as it is covered.

    Level k averages blocks of 2**k cells; its weight is coverage / least, cut to 0..1.
    """
    out = grid.crossJoin(F.broadcast(grid.agg(F.avg("v").alias("level"))))
    for k in range(levels, -1, -1):
        size = 2**k
        if size > 2 * max(rows, cols):
            continue
        block = [F.expr(f"row div {size}").alias("r_"), F.expr(f"col div {size}").alias("c_")]
        mean = grid.groupBy(*block).agg(F.avg("v").alias("m_"), (F.count("v") / (size * size)).alias("den_"))
        out = out.withColumn("r_", F.expr(f"row div {size}")).withColumn("c_", F.expr(f"col div {size}")).join(mean, ["r_", "c_"], "left")
        w = F.least(F.lit(1.0), F.coalesce("den_", F.lit(0.0)) / least)
        out = out.withColumn("level", F.when(F.col("m_").isNotNull(), w * F.col("m_") + (1 - w) * F.col("level")).otherwise(F.col("level"))).drop("r_", "c_", "m_", "den_")
    return out
