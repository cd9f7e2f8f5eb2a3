"""Pipelines: ranking of date pairs, clean lattices, phase screens by three routes, and their application."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import blocks as B
from tessera.operators import fixpoint as P
from tessera.operators import joins as J
from tessera.operators import kernels as K
from tessera.operators import robust as R
from tessera.operators import stencil as T

#: Rungs of correction, in order, with their labels.
RUNGS = {"prerb": "coregistered only", "rb": "+ azimuth rubbersheet", "rbc": "+ carrier compensation", "rbcs": "+ ionospheric screen"}


# ---- ranking -------------------------------------------------------------------------------------------------------
def residual_coherence(coh: DataFrame, incidence: DataFrame | None = None, min_coh: float = 0.15, loo: bool = False) -> DataFrame:
    """(freq, d1, d2, row, col, resid) of coherences (freq, d1, d2, row, col, valid, coh).

    Log coherence less the median of the stack (of the other pairs with loo), in cells that are valid in every pair and
    whose median exceeds min_coh, less a quadratic in incidence (row, col, inc; the column if there is none).
    """
    logs = coh.withColumn("pair", F.concat_ws("_", "freq", "d1", "d2")).withColumn("l", F.when(F.col("valid"), S.log_floor(F.col("coh"))))
    cells = logs.groupBy("row", "col").agg(F.bool_and("valid").alias("all"), F.median("l").alias("med")).where(F.col("all") & (F.col("med") > float(np.log(min_coh))))
    base = B.leave_one_out_median(logs).withColumnRenamed("loo", "base") if loo else logs.join(cells.select("row", "col", F.col("med").alias("base")), ["row", "col"])
    r = base.join(cells.select("row", "col"), ["row", "col"], "left_semi").where("l is not null and base is not null").withColumn("r", F.col("l") - F.col("base"))
    r = r.join(incidence.select("row", "col", F.col("inc").alias("x")), ["row", "col"]) if incidence is not None else r.withColumn("x", F.col("col").cast("double"))
    return R.remove_polynomial(r, "x", "r", ["freq", "d1", "d2"]).select("freq", "d1", "d2", "row", "col", "resid")


def streak_index(coh: DataFrame, smooth_cells: float = 0.0, azimuth: float = 0.0, least: int = 4096, **options) -> DataFrame:
    """(freq, d1, d2, R_fft, theta_fft, D_RA, coh_mean, n_cells): how directional each pair's loss of coherence is.

    The residual is one plan over all pairs; the spectrum of a pair's loss is an array kernel, one group for each pair.
    """
    keys = ["freq", "d1", "d2"]
    resid = residual_coherence(coh, **options)
    loss = resid.withColumn("v", S.loss_field(F.col("resid"))).join(coh.select(*keys, "row", "col", "coh"), [*keys, "row", "col"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, theta, d = K.directionality(K.to_grid(pdf), smooth_cells, azimuth, least)
        none = lambda x: None if not np.isfinite(x) else float(x)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "R_fft": [none(r)], "theta_fft": [none(theta)], "D_RA": [none(d)], "coh_mean": [float(pdf["coh"].mean())], "n_cells": [len(pdf)]}).astype({"R_fft": float, "theta_fft": float, "D_RA": float})

    out = loss.select(*keys, "row", "col", "v", "coh").groupBy(*keys).applyInPandas(run, "freq string, d1 string, d2 string, R_fft double, theta_fft double, D_RA double, coh_mean double, n_cells bigint")
    return out.select(*keys, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("R_fft", "theta_fft", "D_RA")], "coh_mean", "n_cells")


# ---- lattices ------------------------------------------------------------------------------------------------------
def clean_lattice(lattice: DataFrame, search: tuple[float, float], snr_min: float = 8.0, mask: DataFrame | None = None, k: float = 5.0, spike: float = 1.0) -> DataFrame:
    """lattice (row, col, azimuth, range, snr) with keep: masked cells, weak or clipped matches, block outliers and
    spikes are out. Masks come first, before anything is interpolated."""
    good = R.snr_gate(lattice, snr_min).where(R.search_gate(*search))
    if mask is not None:
        good = J.missing(good, mask, ["row", "col"])
    good = P.cut(R.reject_block_outliers(good, ["azimuth", "range"], k))
    kept = P.despike(good.select("row", "col", "azimuth", "range"), ["azimuth", "range"], spike).where("keep").select("row", "col", F.lit(True).alias("keep"))
    return lattice.join(kept, ["row", "col"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def auto_aniso(v: np.ndarray, level: float = 0.10, most: float = 64.0) -> float:
    """Ratio of the lags at which the field differs by `level` along columns and along rows; 1 if it never does."""

    def reach(axis: int) -> float:
        before = None
        for lag in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048):
            if lag >= v.shape[axis]:
                return np.inf
            d = np.abs(v[lag:] - v[:-lag]) if axis == 0 else np.abs(v[:, lag:] - v[:, :-lag])
            d = d[np.isfinite(d)]
            if len(d) < 1000:
                return np.inf
            m = float(np.median(d))
            if m >= level:
                return lag if before is None else before[0] + (level - before[1]) * (lag - before[0]) / (m - before[1])
            before = (lag, m)
        return np.inf

    rows, cols = reach(0), reach(1)
    return float(np.clip(cols / rows, 1 / most, most)) if np.isfinite(rows) and np.isfinite(cols) else 1.0


def fill_channels(lattice: DataFrame, channels: tuple[str, ...] = ("azimuth", "range", "snr"), cutoff: float = 20.0, trust: float = 32.0, spacing: tuple[float, float] = (1.0, 1.0), method: str = "pls", robust: int = 1) -> DataFrame:
    """lattice (row, col, channels, keep) with holes filled channel by channel, and filled.

    Each channel is filled along its own long axis; a cell that the robust fit of azimuth or range rejects becomes a
    hole of every channel. Within the trust radius the fill counts whole, beyond it fades to the regional level.
    Measured cells keep their values. A lattice fits one executor and is one group for each channel.
    """
    s = (cutoff / (2 * np.pi)) ** 4

    def grid(pdf: pd.DataFrame) -> np.ndarray:
        return K.to_grid(pdf.assign(v=pdf["v"].where(pdf["keep"])))

    def rejects(pdf: pd.DataFrame) -> pd.DataFrame:
        y = grid(pdf)
        bad = K.pls_fill(y, s, robust, auto_aniso(y))[2] if robust else np.zeros(y.shape, bool)
        r, c = np.nonzero(bad)
        return pd.DataFrame({"row": r.astype(np.int32), "col": c.astype(np.int32)})

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        y = grid(pdf)
        aniso = 1.0 if pdf["channel"].iloc[0] == "snr" else auto_aniso(y)
        z = K.pls_fill(y, s, aniso=aniso)[0] if method == "pls" else K.fill(y, method)
        ok = np.isfinite(y)
        at = np.argwhere(ok)
        level = K.lowpass(y, (8 * cutoff / 6, 8 * cutoff / 6))
        level = np.where(np.isfinite(level), level, np.nanmean(y) if ok.any() else 0.0)
        near = K.nearest_fill(np.where(ok, np.arange(y.size).reshape(y.shape), np.nan)) if len(at) else np.zeros(y.shape)
        rr, cc = np.indices(y.shape)
        dist = np.hypot((near // y.shape[1] - rr) * spacing[0], (near % y.shape[1] - cc) * spacing[1])
        w = np.where(dist <= trust, 1.0, np.exp(-(((dist - trust) / trust) ** 2)))
        return K.to_long(np.where(ok, y, w * z + (1 - w) * level), channel=pdf["channel"].iloc[0])

    long = lattice.select("row", "col", "keep", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("e")).select("row", "col", "keep", "e.channel", "e.v")
    long = P.cut(long)
    bad = long.where(F.col("channel") != "snr").groupBy("channel").applyInPandas(rejects, "row int, col int").distinct()
    keep = long.join(bad.withColumn("bad", F.lit(True)), ["row", "col"], "left").withColumn("keep", F.col("keep") & F.col("v").isNotNull() & F.col("bad").isNull()).drop("bad")
    keep = P.cut(keep)
    done = keep.groupBy("channel").applyInPandas(filled, "channel string, row int, col int, v double")
    wide = done.groupBy("row", "col").agg(*[F.first(F.when(F.col("channel") == c, F.col("v")), True).alias(c) for c in channels])
    good = keep.where(F.col("channel") == channels[0]).select("row", "col", "keep")
    return wide.join(good, ["row", "col"], "left").withColumn("keep", F.coalesce("keep", F.lit(False))).withColumn("filled", ~F.col("keep") & F.col(channels[0]).isNotNull())


# ---- screens -------------------------------------------------------------------------------------------------------
def offsets_screen(lattice: DataFrame, shape: tuple[int, int], meta: dict, sigma: tuple[float, float] = (2.0, 2.0), gain: float = 1.0, max_gap: float = 8.0, count_filled: bool = False) -> DataFrame:
    """(row, col, screen, valid) from azimuth offsets (row, col, azimuth, keep, filled).

    meta: az_spacing (m), wavelength (m), slant0 and dslant (m, range of column 0 and step), da (m along track for each
    row), dr (m across), and kappa, the fraction of the path at the shell. Low-pass, phase gradient, carried across
    range, integrated along the track and with each column's mean taken off.
    """
    lattice = P.cut(lattice)
    v = lattice.select("row", "col", F.when(F.col("keep"), F.col("azimuth") * meta["az_spacing"]).alias("v"))
    low = P.cut(T.gaussian(v, shape, sigma).select("row", "col", "low"))
    slant = meta["slant0"] + meta["dslant"] * F.col("col")
    grad = low.select("row", "col", S.phase_rate(F.col("low"), meta["wavelength"], slant).alias("v"), "low")
    ds = meta["da"] / meta.get("kappa", 1.0)
    total = T.cumulative(T.carry_across(grad).withColumn("v", F.col("filled") * ds).drop("filled"))
    screen = T.demean(total.select("row", "col", F.col("total").alias("v"), "low")).withColumn("screen", F.col("v") * gain)
    known = lattice.select("row", "col", F.when(F.col("keep"), F.lit(1.0)).alias("v"))
    gap = P.nearest(known, meta["da"] / 1000, meta["dr"] / 1000).select("row", "col", "dist")
    out = screen.join(gap, ["row", "col"]).join(lattice.select("row", "col", "filled"), ["row", "col"])
    valid = F.col("low").isNotNull() & (F.coalesce("dist", F.lit(float("inf"))) <= max_gap)
    return out.select("row", "col", "screen", (valid if count_filled else valid & ~F.col("filled")).alias("valid"))


def split_screen(bands: DataFrame, f0: float, f1: float, shape: tuple[int, int], coh_min: float = 0.3, box: int = 5, sigma: float = 6.0, coh_diff: float = 0.2) -> DataFrame:
    """(row, col, screen, valid) from two bands' phases (row, col, phi_a, phi_b, coh).

    The phasor of the band difference is averaged and gated by its coherence, both are unwrapped as arrays, the
    dispersive part is solved in closed form, outliers of the running median go, and a coherence-weighted low-pass with
    a plane underneath continues it over the frame.
    """
    known = bands.where(F.col("coh") >= coh_min)
    e = F.col("phi_a") - F.col("phi_b")
    ph = known.select("row", "col", "phi_a", "coh", F.cos(e).alias("c"), F.sin(e).alias("s"))
    mean = T.neighbours(ph.select("row", "col", F.col("c").alias("v")), box // 2, median=False).withColumnRenamed("near", "mc").drop("count")
    mean = mean.join(T.neighbours(ph.select("row", "col", F.col("s").alias("v")), box // 2, median=False).withColumnRenamed("near", "ms").drop("count"), ["row", "col"])
    d = ph.join(mean, ["row", "col"]).withColumn("cd", S.magnitude(F.col("mc"), F.col("ms"))).where(F.col("cd") >= coh_diff).withColumn("diff", F.atan2("ms", "mc"))
    d = B.circular_mean(P.cut(d), "diff").withColumnRenamed("turned", "d_turned").withColumnRenamed("datum", "d_datum")
    d = P.cut(d)

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = K.unwrap(K.to_grid(pdf))
        return K.to_long(grid, what=pdf["what"].iloc[0])

    both = d.select("row", "col", F.explode(F.array(F.struct(F.lit("a").alias("what"), S.wrap(F.col("phi_a")).alias("v")), F.struct(F.lit("d").alias("what"), F.col("d_turned").alias("v")))).alias("e")).select("row", "col", "e.what", "e.v")
    un = both.groupBy("what").applyInPandas(turns, "what string, row int, col int, v double").where("v is not null")
    wide = un.groupBy("row", "col").agg(F.first(F.when(F.col("what") == "a", F.col("v")), True).alias("ua"), F.first(F.when(F.col("what") == "d", F.col("v")), True).alias("ud")).join(d.select("row", "col", "cd", "d_datum"), ["row", "col"])
    disp, _ = S.split_solve(F.col("ua"), F.col("ud") + F.col("d_datum"), f0, f1)
    # every step below reads its input several times
    solved = R.reject_median9(P.cut(wide.select("row", "col", disp.alias("v"), "cd"))).select("row", "col", "v", "cd")
    grid = P.grid_cells(bands.sparkSession, *shape).join(solved, ["row", "col"], "left")
    trend = P.cut(R.plane(P.cut(grid)))
    low = T.gaussian(trend.withColumn("v", F.col("v") - F.col("trend")), shape, (sigma, sigma), weight="cd", floor=0.05)
    out = P.cut(trend.join(low, ["row", "col"]).withColumn("screen", F.col("trend") + F.coalesce("low", F.lit(0.0))))
    mean_all = out.agg(F.avg("screen").alias("m_"))
    return out.crossJoin(F.broadcast(mean_all)).select("row", "col", (F.col("screen") - F.col("m_")).alias("screen"), F.col("v").isNotNull().alias("valid"))


def hybrid_screen(split: DataFrame, offsets: DataFrame, shape: tuple[int, int], cut_km: float, row_m: float) -> DataFrame:
    """(row, col, screen, valid): scales above cut_km (full width at half maximum) from split, shorter ones from offsets."""
    split, offsets = P.cut(split), P.cut(offsets)
    v = lambda x: x.select("row", "col", F.col("screen").alias("v"))
    sigma = cut_km * 1000 / row_m / 2.355
    out = T.hybrid_scales(v(split), v(offsets), *shape, sigma).withColumnRenamed("v", "screen")
    ok = split.select("row", "col", F.col("valid").alias("a")).join(offsets.select("row", "col", F.col("valid").alias("b")), ["row", "col"])
    return out.join(ok, ["row", "col"]).select("row", "col", "screen", (F.col("a") & F.col("b")).alias("valid"))


def apply_screen(ifg: DataFrame, screen: DataFrame, sign: float = -1.0) -> DataFrame:
    """ifg (row, col, re, im, ...) rotated by sign * screen; cells without a screen become missing. sign 1 takes it back."""
    re, im = S.rotate(F.col("re"), F.col("im"), sign * F.col("screen"))
    out = ifg.join(screen.select("row", "col", "screen"), ["row", "col"], "left")
    return out.withColumn("re2", re).withColumn("im2", im).drop("re", "im", "screen").withColumnsRenamed({"re2": "re", "im2": "im"})


#: Screen builders by route; each gives (row, col, screen, valid).
ROUTES: dict[str, Callable[..., DataFrame]] = {"offsets": offsets_screen, "split": split_screen, "hybrid": hybrid_screen}


# ---- matching and refocusing ----------------------------------------------------------------------------------------
def match_windows(ref: DataFrame, sec: DataFrame, window: int, search: int, skip: int, shape: tuple[int, int]) -> DataFrame:
    """(row, col, azimuth, range, snr) by correlation of amplitude windows of two rasters (row, col, v).

    Every node names its window's rows of blocks; cells are dealt to the nodes that read them, and each node is one
    small group.
    """
    nodes = [max((n - window - 2 * search) // skip, 0) for n in shape]
    span = window + 2 * search

    def reads(name: str, n: int) -> F.Column:
        c = F.col(name)
        low = F.greatest(F.lit(0), F.ceil((c - span + 1) / skip)).cast("int")
        high = F.least(F.lit(n - 1), F.floor(c / skip)).cast("int")
        return F.when(low <= high, F.sequence(low, high))

    dealt = lambda df, side: df.withColumn("side", F.lit(side)).withColumn("i", F.explode(reads("row", nodes[0]))).withColumn("j", F.explode(reads("col", nodes[1])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        boxes = []
        for side in ("r", "s"):
            p = pdf[pdf["side"] == side]
            a = np.zeros((span, span))
            a[p["row"] - i * skip, p["col"] - j * skip] = p["v"].fillna(0.0)
            boxes.append(a)
        inner = boxes[0][search : search + window, search : search + window]
        az, rg, snr = K.match_offset(inner, boxes[1], search) if inner.any() and boxes[1].any() else (np.nan,) * 3
        return pd.DataFrame({"row": [i], "col": [j], "azimuth": [az], "range": [rg], "snr": [snr]}).astype({"row": np.int32, "col": np.int32})

    both = dealt(ref.select("row", "col", "v"), "r").unionByName(dealt(sec.select("row", "col", "v"), "s"))
    out = both.groupBy("i", "j").applyInPandas(run, "row int, col int, azimuth double, range double, snr double")
    return out.select("row", "col", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("azimuth", "range", "snr")])


def refocus_self_test(seed: int = 0, lines: int = 960, samples: int = 32, prf: float = 1520.0) -> dict[str, float]:
    """Coherences of a made-up pair: as distorted, as refocused, with the wrong sign; and the error of a zero shift."""
    rng = np.random.default_rng(seed)
    ref = rng.normal(size=(lines, samples)) + 1j * rng.normal(size=(lines, samples))
    shift = lambda c, f: 4.0 * np.sin(2 * np.pi * (c / lines + f / prf))
    back = lambda c, f: -shift(c, f)
    bent = K.refocus(ref, shift, prf, block=240, hop=120)
    coh = lambda a, b: float(abs((a * b.conj()).sum()) / np.sqrt((abs(a) ** 2).sum() * (abs(b) ** 2).sum()))
    return {"distorted": coh(ref, bent), "refocused": coh(ref, K.refocus(bent, back, prf)), "wrong": coh(ref, K.refocus(bent, shift, prf)), "identity": float(np.abs(K.refocus(ref, lambda c, f: 0 * f, prf) - ref).max())}
