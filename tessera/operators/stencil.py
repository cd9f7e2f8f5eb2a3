"""Window and neighbourhood operators over long-form rasters (by..., row, col, v).

One-dimensional frames are ROWS windows inside a row or column; two-dimensional neighbourhoods are joins with an
offset table of fixed size, or two one-dimensional passes where the kernel separates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def axis_window(axis: str, by: Sequence[str] = ()):
    """Cells of one column in row order (axis "row"), or of one row in column order (axis "col")."""
    return W.partitionBy(*by, "col" if axis == "row" else "row").orderBy(axis)


def edge_padded(df: DataFrame, axis: str, size: int, reach: int, mode: str = "reflect") -> DataFrame:
    """df with copies of cells beyond both ends of an axis of `size` cells: mirrored with the edge twice, or the edge."""
    if mode == "constant":
        return df
    if mode == "reflect":
        low = df.where(F.col(axis) < reach).withColumn(axis, -1 - F.col(axis))
        high = df.where(F.col(axis) >= size - reach).withColumn(axis, 2 * size - 1 - F.col(axis))
    else:
        steps = F.explode(F.sequence(F.lit(1), F.lit(reach)))
        low = df.where(F.col(axis) == 0).withColumn("k_", steps).withColumn(axis, -F.col("k_")).drop("k_")
        high = df.where(F.col(axis) == size - 1).withColumn("k_", steps).withColumn(axis, size - 1 + F.col("k_")).drop("k_")
    cast = lambda x: x.withColumn(axis, F.col(axis).cast("int"))
    return df.unionByName(cast(low)).unionByName(cast(high))


def box_mean(df: DataFrame, shape: tuple[int, int], size: int, value: str = "v", mode: str = "reflect", by: Sequence[str] = ()) -> DataFrame:
    """The mean of the values in the size x size box, as two ROWS passes of sums and counts.

    The grid is full: a cell without a value has a row with null. mode constant counts cells outside as 0.
    """
    h = size // 2
    out = df.select(*by, "row", "col", F.coalesce(value, F.lit(0.0)).alias("num"), F.col(value).isNotNull().cast("double").alias("den"))
    for axis, n in (("row", shape[0]), ("col", shape[1])):
        w = axis_window(axis, by).rowsBetween(-h, h)
        out = edge_padded(out, axis, n, h, mode).withColumn("num", F.sum("num").over(w)).withColumn("den", F.sum("den").over(w)).where((F.col(axis) >= 0) & (F.col(axis) < n))
    den = F.lit(float(size * size)) if mode == "constant" else F.col("den")
    return out.select(*by, "row", "col", F.try_divide("num", den).alias(value))


def offsets(reach: int, centre: bool = True):
    """The array of (dr, dc) of a square neighbourhood."""
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if centre or (r, c) != (0, 0)])


def neighbours(df: DataFrame, reach: int, centre: bool = True, value: str = "v", by: Sequence[str] = (), median: bool = True) -> DataFrame:
    """(by, row, col, near, count): median (or mean) and number of the neighbours that have a value."""
    sent = df.where(F.col(value).isNotNull()).select(*by, "row", "col", value, F.explode(offsets(reach, centre)).alias("o"))
    sent = sent.select(*by, (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), value)
    return sent.groupBy(*by, "row", "col").agg((F.median(value) if median else F.avg(value)).alias("near"), F.count("*").alias("count"))


def running_median(df: DataFrame, size: int, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """df with med: the median of the cells of the size x size box that have a value."""
    near = neighbours(df, size // 2, True, value, by).withColumnRenamed("near", "med").drop("count")
    return df.join(near, [*by, "row", "col"], "left")


def spikes(df: DataFrame, limit: float, reach: int = 3, least: int = 3, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """df with near, count and spike: further than `limit` from the median of the neighbours, or with too few of them."""
    out = df.join(neighbours(df, reach, False, value, by), [*by, "row", "col"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return out.withColumn("spike", F.col(value).isNotNull() & ((F.col("count") < least) | F.coalesce(F.abs(F.col(value) - F.col("near")) > limit, F.lit(False))))


def gaussian_kernel(sigma: float) -> list[float]:
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(w)
    return [x / total for x in w]


def gaussian(df: DataFrame, shape: tuple[int, int], sigma: tuple[float, float], value: str = "v", weight: str | None = None, floor: float = 0.05, mode: str = "reflect", by: Sequence[str] = ()) -> DataFrame:
    """(by, row, col, low, share): the Gaussian mean over cells that have a value, null where their weight is below floor.

    The kernel separates into two passes; each sends a cell to the cells in its reach and sums, so a pass shuffles
    partial sums only. Long kernels are better cut by a block mean first.
    """
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    out = df.withColumn("den", F.when(F.col(value).isNotNull(), w).otherwise(0.0)).withColumn("num", F.coalesce(F.col(value), F.lit(0.0)) * F.col("den")).select(*by, "row", "col", "num", "den")
    for axis, n, s in (("row", shape[0], sigma[0]), ("col", shape[1], sigma[1])):
        if not s:
            continue
        k = gaussian_kernel(s)
        reach = len(k) // 2
        taps = F.array(*[F.struct(F.lit(i - reach).alias("d"), F.lit(x).alias("w")) for i, x in enumerate(k)])
        sent = edge_padded(out, axis, n, reach, mode).withColumn("t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("t.d"))
        sent = sent.where((F.col(axis) >= 0) & (F.col(axis) < n))
        out = sent.groupBy(*by, "row", "col").agg(F.sum(F.col("num") * F.col("t.w")).alias("num"), F.sum(F.col("den") * F.col("t.w")).alias("den"))
    return out.select(*by, "row", "col", F.when(F.col("den") > floor, F.col("num") / F.col("den")).alias("low"), F.col("den").alias("share"))


def cumulative(df: DataFrame, value: str = "v", axis: str = "row", by: Sequence[str] = ()) -> DataFrame:
    """df with total: the inclusive running sum along the axis."""
    return df.withColumn("total", F.sum(value).over(axis_window(axis, by).rowsBetween(W.unboundedPreceding, 0)))


def demean(df: DataFrame, value: str = "v", key: Sequence[str] = ("col",)) -> DataFrame:
    return df.withColumn(value, F.col(value) - F.avg(value).over(W.partitionBy(*key)))


def carry_across(df: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """df with filled: linear between known cells of a row, constant beyond them, 0 in a row without any."""
    at = F.when(F.col(value).isNotNull(), F.col("col"))
    back, ahead = axis_window("col", by).rowsBetween(W.unboundedPreceding, 0), axis_window("col", by).rowsBetween(0, W.unboundedFollowing)
    out = df.withColumn("p_", F.last(value, True).over(back)).withColumn("pc_", F.last(at, True).over(back)).withColumn("n_", F.first(value, True).over(ahead)).withColumn("nc_", F.first(at, True).over(ahead))
    between = F.col("p_") + (F.col("n_") - F.col("p_")) * F.try_divide((F.col("col") - F.col("pc_")).cast("double"), (F.col("nc_") - F.col("pc_")).cast("double"))
    return out.withColumn("filled", F.coalesce(F.col(value), between, F.col("p_"), F.col("n_"), F.lit(0.0))).drop("p_", "pc_", "n_", "nc_")


def gradient(df: DataFrame, value: str = "v", axis: str = "row", by: Sequence[str] = ()) -> DataFrame:
    """df with slope: central differences inside, one-sided at the ends."""
    w = axis_window(axis, by)
    ahead, back = F.lead(value).over(w), F.lag(value).over(w)
    return df.withColumn("slope", F.coalesce((ahead - back) / 2, ahead - F.col(value), F.col(value) - back))


def wrapped_difference(df: DataFrame, value: str = "v", axis: str = "row", by: Sequence[str] = ()) -> DataFrame:
    """df with step: the wrapped difference to the next cell of the axis; null if that cell is missing."""
    w = axis_window(axis, by)
    d = F.lead(value).over(w) - F.col(value)
    return df.withColumn("step", F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.atan2(F.sin(d), F.cos(d))))


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """df with area: the trapezoid integral of y over x, which is 0 at the first x that isn't negative."""
    w = W.partitionBy(*by).orderBy(x)
    part = F.coalesce(0.5 * (F.col(y) + F.lag(y).over(w)) * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    out = df.withColumn("p_", part).withColumn("s_", F.sum("p_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    zero = F.first(F.when(F.col(x) >= 0, F.col("s_")), True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return out.withColumn("area", F.col("s_") - F.coalesce(zero, F.lit(0.0))).drop("p_", "s_")


def first_crossing(df: DataFrame, x: str, y: str, target: float, by: Sequence[str]) -> DataFrame:
    """(by, reach): the x at which y first reaches the target, linear between points; infinity if it never does."""
    w = W.partitionBy(*by).orderBy(x)
    out = df.where(F.col(y).isNotNull()).withColumn("x0", F.lag(x).over(w)).withColumn("y0", F.lag(y).over(w))
    at = F.when(F.col("y0").isNull(), F.col(x).cast("double")).otherwise(F.col("x0") + (F.lit(target) - F.col("y0")) * F.try_divide((F.col(x) - F.col("x0")).cast("double"), F.col(y) - F.col("y0")))
    hit = out.where(F.col(y) >= target).groupBy(*by).agg(F.min_by(at, x).alias("reach"))
    return df.select(*by).distinct().join(hit, list(by), "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))


def structure_function(df: DataFrame, lags: Sequence[int], least: int, axis: str = "col", value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """(by, lag, n, sf): the median of |v(x + lag) - v(x)|, null with fewer than `least` pairs."""
    known = df.where(F.col(value).isNotNull()).select(*by, "row", "col", value)
    sent = known.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn(axis, F.col(axis) + F.col("lag")).withColumnRenamed(value, "w_")
    pairs = sent.join(known, [*by, "row", "col"])
    out = pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), F.median(F.abs(F.col("w_") - F.col(value))).alias("sf"))
    return out.withColumn("sf", F.when(F.col("n") >= least, F.col("sf")))


def hybrid_scales(split: DataFrame, off: DataFrame, rows: int, cols: int, sigma_rows: float, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """Long scales of `split` with the short ones of `off`: low(split) + off - low(off), along rows only."""
    keys = [*by, "row", "col"]
    low = lambda x, name: gaussian(x, (rows, cols), (sigma_rows, 0.0), value, mode="nearest", by=by, floor=-1.0).select(*keys, F.col("low").alias(name))
    out = off.join(low(split, "ls"), keys).join(low(off, "lo"), keys)
    return out.select(*keys, (F.col("ls") + F.col(value) - F.col("lo")).alias(value))
