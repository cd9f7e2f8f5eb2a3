"""Gates, outlier rejection, regressions and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import cell
from .selection import median
from .stencil import running_median


def snr_gate(lattice: DataFrame, snr_min: float) -> DataFrame:
    return lattice.where(F.col("azimuth").isNotNull() & F.col("range").isNotNull() & (F.col("snr") >= snr_min))


def search_gate(search_az: float, search_rg: float, share: float = 0.9) -> Column:
    """Whether both offsets lie clear of the search limit."""
    return (F.abs("azimuth") < share * search_az) & (F.abs("range") < share * search_rg)


def reject_block_outliers(df: DataFrame, channels: Sequence[str], k: float = 5.0, size: int = 8) -> DataFrame:
    """The rows of df (row, col, channels) that pass each channel in turn.

    Within blocks of size x size, r = v - median and sigma = 1.4826 median |r|; the floor is the median of all blocks'
    sigmas, and rows with |r| > k max(sigma, floor) go before the next channel is looked at.
    """
    out = df
    for c in channels:
        keys = ["b1_", "b2_"]
        out = out.withColumn("b1_", cell("row", size)).withColumn("b2_", cell("col", size))
        med = out.groupBy(*keys).agg(F.median(c).alias("med_"))
        out = out.join(med, keys).withColumn("r_", F.abs(F.col(c) - F.col("med_")))
        sigma = out.groupBy(*keys).agg((1.4826 * F.median("r_")).alias("sigma_"))
        floor = sigma.agg(F.median("sigma_").alias("floor_"))
        out = out.join(sigma, keys).crossJoin(F.broadcast(floor)).where(F.col("r_") <= k * F.greatest("sigma_", "floor_")).drop(*keys, "med_", "r_", "sigma_", "floor_")
    return out


def reject_median9(df: DataFrame, n: float = 3.0, value: str = "v", size: int = 9) -> DataFrame:
    """Rows within n * 1.4826 * MAD (of all values) of the running median."""
    mid = median(df, value)
    wide = median(df, F.abs(F.col(value) - F.lit(mid)))
    out = running_median(df.where(F.col(value).isNotNull()), size, value)
    return out.where(F.abs(F.col(value) - F.col("med")) < F.lit(wide) * n * 1.4826)


def _solve3(s: dict[str, Column], b: Sequence[Column]) -> list[Column]:
    """Cramer's rule for a symmetric 3 x 3 system, keys 00 01 02 11 12 22."""
    m = [[s["00"], s["01"], s["02"]], [s["01"], s["11"], s["12"]], [s["02"], s["12"], s["22"]]]
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    whole = det(m)
    return [F.try_divide(det([[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]), whole) for k in range(3)]


def least_squares3(df: DataFrame, terms: Sequence[Column], value: Column, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, c0, c1, c2): the weighted least-squares coefficients of three terms, from sums of products."""
    w = weight if weight is not None else F.lit(1.0)
    names = [f"{a}{b}" for a in range(3) for b in range(a, 3)]
    sums = df.groupBy(*by).agg(*[F.sum(w * terms[int(n[0])] * terms[int(n[1])]).alias(f"s{n}") for n in names], *[F.sum(w * terms[k] * value).alias(f"b{k}") for k in range(3)])
    c = _solve3({n: F.col(f"s{n}") for n in names}, [F.col(f"b{k}") for k in range(3)])
    return sums.select(*by, *[x.alias(f"c{k}") for k, x in enumerate(c)])


def remove_polynomial(df: DataFrame, x: str, value: str, by: Sequence[str]) -> DataFrame:
    """df with resid: value less its quadratic in x - mean(x) within each group, and less the mean of what is left."""
    mean = df.groupBy(*by).agg(F.avg(x).alias("xm_"))
    d = df.join(mean, list(by)).withColumn("xc_", F.col(x) - F.col("xm_"))
    xc = F.col("xc_")
    fit = least_squares3(d, [F.lit(1.0), xc, xc * xc], F.col(value), by=by)
    out = d.join(fit, list(by)).withColumn("resid", F.col(value) - F.col("c0") - F.col("c1") * xc - F.col("c2") * xc * xc)
    return out.withColumn("resid", F.col("resid") - F.avg("resid").over(W.partitionBy(*by))).drop("xm_", "xc_", "c0", "c1", "c2")


def plane(df: DataFrame, value: str = "v", least: int = 100, weight: str | None = None) -> DataFrame:
    """df with trend: the least-squares plane in (row, col), 0 where fewer than `least` cells have a value."""
    known = df.where(F.col(value).isNotNull())
    fit = least_squares3(known, [F.lit(1.0), F.col("row").cast("double"), F.col("col").cast("double")], F.col(value), F.col(weight) if weight else None)
    fit = fit.crossJoin(known.agg(F.count("*").alias("n_")))
    out = df.crossJoin(F.broadcast(fit))
    return out.withColumn("trend", F.when(F.col("n_") >= least, F.col("c0") + F.col("c1") * F.col("row") + F.col("c2") * F.col("col")).otherwise(0.0)).drop("c0", "c1", "c2", "n_")


def line_fit(df: DataFrame, x: str, y: str, least: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, slope, corr); null with fewer than `least` pairs."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("corr"))
    return out.withColumn("slope", F.when(F.col("n") >= least, F.col("slope"))).withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def amplitude_gate(df: DataFrame, x: str, y: str, corr: float = 0.9, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """One row: correlation, the bracket [sxy/sxx, syy/sxy] of the amplitude in order, and whether both are acceptable."""
    s = df.agg(F.corr(x, y).alias("corr"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"))
    a, b = F.try_divide(F.col("sxy"), F.col("sxx")), F.try_divide(F.col("syy"), F.col("sxy"))
    s = s.select("corr", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return s.withColumn("pass", (F.col("corr") >= corr) & (F.col("low") >= low) & (F.col("high") <= high))


def rank_pairs(index: DataFrame, freq: str, top: int | None = None, weak: float = 0.5) -> DataFrame:
    """Rows of one frequency by R_fft, largest first and nulls last, with rank, direction and whether it is weak."""
    w = W.orderBy(F.col("R_fft").cast("double").desc_nulls_last(), "d1", "d2")
    # one row for each pair of dates
    out = index.where(F.col("freq") == freq).withColumn("rank", F.row_number().over(w))
    out = out.withColumn("direction", F.when(F.col("D_RA") >= 0, "range").otherwise("azimuth")).withColumn("weak", F.col("R_fft").cast("double") < weak)
    return out.where(F.col("rank") <= top) if top else out


def best_step(df: DataFrame, block: Sequence[str], step: str, score: str) -> DataFrame:
    """(block, step): the step with the highest score, the smallest of equals; by max_by, so partial sums combine."""
    return df.groupBy(*block).agg(F.min_by(step, F.struct(-F.col(score), F.col(step))).alias(step))


def separated_peaks(spark, df: DataFrame, k: int, rows: int, cols: int, inside: Column) -> DataFrame:
    """Up to k cells (row, col, v) of highest v, each suppressing +-rows x +-cols around it; only those `inside` count.

    Blocks of a grid are few; each of the rounds is one max_by and the chosen cells are a literal filter.
    """
    chosen, left = [], df.where(F.col("v").isNotNull())
    while len(chosen) < k:
        top = left.agg(F.min_by(F.struct("row", "col", "v", inside.alias("inside")), F.struct(-F.col("v"), F.col("row"), F.col("col"))).alias("t")).first()["t"]
        if top is None:
            break
        if top["inside"]:
            chosen.append((top["row"], top["col"], top["v"], len(chosen) + 1))
        left = left.where(~(F.col("row").between(top["row"] - rows, top["row"] + rows) & F.col("col").between(top["col"] - cols, top["col"] + cols)))
    return spark.createDataFrame(chosen, "row int, col int, v double, rank int")
