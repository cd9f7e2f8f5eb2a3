"""Block aggregates, coherence and the date stack, over long-form rasters (by..., row, col, values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import magnitude, times_conj

from .selection import median, percentiles


def cell(name: str, size: int):
    return F.expr(f"{name} div {size}").cast("int")


def block_sum(df: DataFrame, fy: int, fx: int, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums and count by block; algebraic, so partial sums go before the shuffle."""
    return df.groupBy(*by, cell("row", fy).alias("row"), cell("col", fx).alias("col")).agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("n"))


def rebin_split(df: DataFrame, size: int, rows: int, cols: int, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """Total, even-parity and odd-parity sums of size x size blocks, without the ragged edge."""
    inside = df.where((F.col("row") < rows // size * size) & (F.col("col") < cols // size * size))
    even = (F.col("row") + F.col("col")) % 2 == 0
    return inside.groupBy(*by, cell("row", size).alias("row"), cell("col", size).alias("col")).agg(F.sum(value).alias("total"), F.coalesce(F.sum(F.when(even, F.col(value))), F.lit(0.0)).alias("even"), F.coalesce(F.sum(F.when(~even, F.col(value))), F.lit(0.0)).alias("odd"))


def date_pairs(dates: DataFrame, date: str = "d") -> DataFrame:
    """(d1, d2) with d1 < d2; one row for each date goes in."""
    a, b = dates.select(F.col(date).alias("d1")).distinct(), dates.select(F.col(date).alias("d2")).distinct()
    return a.join(b, F.col("d1") < F.col("d2"))


def accumulate(stack: DataFrame, fy: int, fx: int, date: str = "d", by: Sequence[str] = ("freq",)) -> DataFrame:
    """(by, d1, d2, row, col, z_re, z_im, p1, p2, n) by block for every pair of dates of a stack (by, date, row, col, re, im).

    Powers and valid counts are summed once for each date and joined to the pairs; the pair products come from one
    join on the cell, so a cell with k dates makes k (k - 1) / 2 rows. n is the smaller valid share of the block.
    Null samples count as missing.
    """
    keys = [*by, "row", "col"]
    s = stack.where("re is not null and im is not null").select(*by, F.col(date).alias("d"), "row", "col", "re", "im")
    blocks = [cell("row", fy).alias("row"), cell("col", fx).alias("col")]
    own = s.groupBy(*by, "d", *blocks).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"), F.sum(((F.col("re") != 0) | (F.col("im") != 0)).cast("long")).alias("ok"))
    b = s.select(*keys, F.col("d").alias("d2"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    pairs = s.join(b, keys).where("d < d2")
    re, im = times_conj(F.col("re"), F.col("im"), F.col("re2"), F.col("im2"))
    z = pairs.groupBy(*by, F.col("d").alias("d1"), "d2", *blocks).agg(F.sum(re).alias("z_re"), F.sum(im).alias("z_im"))
    first = own.select(*keys, F.col("d").alias("d1"), F.col("p").alias("p1"), F.col("ok").alias("ok1"))
    second = own.select(*keys, F.col("d").alias("d2"), F.col("p").alias("p2"), F.col("ok").alias("ok2"))
    out = z.join(first, [*keys, "d1"]).join(second, [*keys, "d2"])
    return out.select(*by, "d1", "d2", "row", "col", "z_re", "z_im", "p1", "p2", (F.least("ok1", "ok2") / (fy * fx)).alias("n"))


def block_power(samples: DataFrame, fy: int, fx: int, date: str = "d", by: Sequence[str] = ("freq",)) -> DataFrame:
    """(by, d, row, col, p, ok): the power and the valid samples of each date and block."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    s = samples.where("re is not null and im is not null")
    return s.groupBy(*by, F.col(date).alias("d"), cell("row", fy).alias("row"), cell("col", fx).alias("col")).agg(F.sum(power).alias("p"), F.sum((power > 0).cast("long")).alias("ok"))


def accumulate_new(new: DataFrame, every: DataFrame, power: DataFrame, fy: int, fx: int, by: Sequence[str] = ("freq",)) -> DataFrame:
    """What accumulate() gives of the pairs that have a date of `new`, from the samples of those dates, of all dates
    (by, d, row, col, re, im) and the power of all dates (block_power).

    Cells of new dates join those of all dates, so dates that were there before are never paired with each other. A pair of
    two new dates is met once, from its earlier date.
    """
    keys = [*by, "row", "col"]
    valid = "re is not null and im is not null"
    a = new.where(valid).select(*keys, F.col("d").alias("dn"), F.col("re").alias("re1"), F.col("im").alias("im1"))
    fresh = F.broadcast(new.select(F.col("d").alias("df")).distinct())  # the dates of one batch
    b = every.where(valid).select(*keys, "d", "re", "im").join(fresh, F.col("d") == F.col("df"), "left")
    pairs = a.join(b, keys).where((F.col("d") != F.col("dn")) & (F.col("df").isNull() | (F.col("dn") < F.col("d"))))
    first = F.col("dn") < F.col("d")
    re, im = times_conj(F.col("re1"), F.col("im1"), F.col("re"), F.col("im"))
    blocks = [cell("row", fy).alias("row"), cell("col", fx).alias("col")]
    z = pairs.groupBy(*by, F.least("dn", "d").alias("d1"), F.greatest("dn", "d").alias("d2"), *blocks).agg(F.sum(re).alias("z_re"), F.sum(F.when(first, im).otherwise(-im)).alias("z_im"))
    of = lambda n: power.select(*keys, F.col("d").alias(f"d{n}"), F.col("p").alias(f"p{n}"), F.col("ok").alias(f"ok{n}"))
    out = z.join(of(1), [*keys, "d1"]).join(of(2), [*keys, "d2"])
    return out.select(*by, "d1", "d2", "row", "col", "z_re", "z_im", "p1", "p2", (F.least("ok1", "ok2") / (fy * fx)).alias("n"))


def merge_accumulations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two accumulations of disjoint pairs as one; rows of `new` replace rows of equal key."""
    keys = ["freq", "d1", "d2", "row", "col"]
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def coherence(acc: DataFrame, least: float = 0.5) -> DataFrame:
    """acc with valid and coh = |z| / sqrt(p1 p2) in 0..1, 0 where invalid."""
    valid = (F.col("n") > least) & (F.col("p1") > 0) & (F.col("p2") > 0)
    ratio = F.try_divide(magnitude(F.col("z_re"), F.col("z_im")), F.sqrt(F.col("p1") * F.col("p2")))
    return acc.withColumn("valid", valid).withColumn("coh", F.when(valid, F.least(F.lit(1.0), ratio)).otherwise(0.0))


def multilook(pair: DataFrame, looks: tuple[int, int], shape: tuple[int, int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(row, col, z_re, z_im, p1, p2, coh) of a pair (row, col, r_re, r_im, s_re, s_im); shape crops the ragged edge."""
    if shape:
        pair = pair.where((F.col("row") < shape[0] // looks[0] * looks[0]) & (F.col("col") < shape[1] // looks[1] * looks[1]))
    re, im = times_conj(F.col("r_re"), F.col("r_im"), F.col("s_re"), F.col("s_im"))
    power = lambda p: F.sum(F.col(f"{p}_re") * F.col(f"{p}_re") + F.col(f"{p}_im") * F.col(f"{p}_im"))
    out = pair.groupBy(*by, cell("row", looks[0]).alias("row"), cell("col", looks[1]).alias("col")).agg(F.sum(re).alias("z_re"), F.sum(im).alias("z_im"), power("r").alias("p1"), power("s").alias("p2"))
    return out.withColumn("coh", magnitude(F.col("z_re"), F.col("z_im")) / F.sqrt(F.greatest(F.col("p1") * F.col("p2"), F.lit(1e-30))))


def stack_median(logs: DataFrame, key: str = "pair", value: str = "l") -> DataFrame:
    """(row, col, med, n) over the pairs of a cell, nulls apart."""
    return logs.groupBy("row", "col").agg(F.median(value).alias("med"), F.count(value).alias("n"))


def leave_one_out_median(logs: DataFrame, key: str = "pair", value: str = "l") -> DataFrame:
    """logs with loo: the median over the other pairs of the cell.

    With the values of a cell in order the median without one of them is the middle of the rest, which its place alone
    decides. Places and middles come from frames over the same rows, without a join: logs that are worked out a second time
    have sums in another order, whose last digits would not be found again.
    """
    cell_ = W.partitionBy("row", "col")
    out = logs.withColumn("at", F.row_number().over(cell_.orderBy(F.asc_nulls_last(value))) - 1).withColumn("rest", F.count(value).over(cell_) - 1)
    low, high = F.floor((F.col("rest") - 1) / 2), F.floor(F.col("rest") / 2)
    nth = lambda k: F.max(F.when(F.col("at") == k, F.col(value))).over(cell_)
    out = out.withColumns({"m0": nth(low), "m1": nth(low + 1), "m2": nth(high), "m3": nth(high + 1)})
    middle = F.when(F.col("at") <= low, F.col("m1")).otherwise(F.col("m0")) + F.when(F.col("at") <= high, F.col("m3")).otherwise(F.col("m2"))
    return out.withColumn("loo", F.when((F.col("rest") > 0) & F.col(value).isNotNull(), middle / 2)).drop("at", "rest", "m0", "m1", "m2", "m3")


def block_median(df: DataFrame, size: int, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """df with block_med and block_mad (median absolute deviation from it) of its size x size block."""
    keys = [*by, "by_", "bx_"]
    cells = df.withColumn("by_", cell("row", size)).withColumn("bx_", cell("col", size))
    med = cells.groupBy(*keys).agg(F.median(value).alias("block_med"))
    cells = cells.join(med, keys)
    mad = cells.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("block_med"))).alias("block_mad"))
    return cells.join(mad, keys).drop("by_", "bx_")


def circular_mean(df: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """df with datum, the circular mean, and turned, the value rotated by it."""
    mean = df.groupBy(*by).agg(F.atan2(F.avg(F.sin(value)), F.avg(F.cos(value))).alias("datum"))
    out = df.join(mean, list(by)) if by else df.crossJoin(F.broadcast(mean))  # one row
    d = F.col(value) - F.col("datum")
    return out.withColumn("turned", F.atan2(F.sin(d), F.cos(d)))


def residual_constant(df: DataFrame, value: str = "v", least: int = 20) -> DataFrame:
    """One row (med, sigma, n, level): the median of the values within three robust deviations of the median.

    sigma is 1.4826 times the median absolute deviation, 1e-6 at least; fewer than `least` values raise an error.
    """
    mid = median(df, value)
    wide = median(df.where(F.col(value).isNotNull()), F.abs(F.col(value) - F.lit(mid)))
    sigma = None if wide is None else max(1.4826 * wide, 1e-6)
    kept = df.where(F.abs(F.col(value) - F.lit(mid)) <= F.lit(sigma) * 3)
    level, n = median(kept, value), df.where(F.col(value).isNotNull()).count()
    out = df.sparkSession.createDataFrame([(mid, sigma, n, level)], "med double, sigma double, n long, level double")
    return out.withColumn("level", F.when(F.coalesce("n", F.lit(0)) >= least, F.col("level")).otherwise(F.raise_error(F.lit("too few values for a constant")).cast("double")))


def stats(df: DataFrame, value: str = "v") -> DataFrame:
    """One row: share of valid values, 1st, 50th and 99th percentile, and the symmetric limit around the median."""
    low, mid, high = percentiles(df, value, (0.01, 0.5, 0.99))
    (half,) = percentiles(df, F.abs(F.col(value) - F.lit(mid)), (0.98,))
    p = df.agg(F.avg(F.col(value).isNotNull().cast("double")).alias("valid"))
    return p.select("valid", *[F.lit(x).cast("double").alias(n) for n, x in (("p01", low), ("p50", mid), ("p99", high), ("half_width", half))])


def largest_share(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share) by descending size."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")
