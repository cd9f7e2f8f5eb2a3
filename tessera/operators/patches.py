"""Spectral filters by overlapping patches, over tiles with a halo, so that no filter needs a whole grid in one group."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiling import by_tiles


def _boxed(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums under a small window of weights, zeros beyond the edge."""
    half = weights.shape[0] // 2
    p = np.pad(a, half)
    return sum(w * p[i : i + a.shape[0], j : j + a.shape[1]] for (i, j), w in np.ndenumerate(weights) if w)


def patch_filter(z: np.ndarray, r0: int, c0: int, shape: tuple[int, int], alpha: float, nfft: int, step: int, least: float, beta: float, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered, coherence) of a piece of a complex image that begins at (r0, c0) of the whole.

    Patches of nfft cells are centred on every step-th line and sample of the whole image, so pieces agree on them. A
    patch with enough samples is weighted by a Kaiser window and its spectrum multiplied by its own magnitude to the
    power of alpha; the step cells around its centre are kept. Coherence is the length of the window's weighted mean
    phasor, and the result has it for its length.
    """
    half, lead = nfft // 2, step // 2
    pad = nfft + step
    p = np.pad(np.nan_to_num(z), pad)
    taper = np.outer(np.kaiser(nfft, beta), np.kaiser(nfft, beta))
    out = np.zeros(z.shape, complex)
    h, w = z.shape
    centres = lambda first, n, whole: [k for k in range(-(-(first - step) // step) * step, first + n + step, step) if 0 <= k < whole + lead]
    for i in centres(r0, h, shape[0]):
        a = i - r0 + pad - half
        if a < 0 or a + nfft > p.shape[0]:
            continue
        for j in centres(c0, w, shape[1]):
            b = j - c0 + pad - half
            if b < 0 or b + nfft > p.shape[1]:
                continue
            patch = p[a : a + nfft, b : b + nfft]
            if np.count_nonzero(patch) < int(least * nfft * nfft):
                continue
            spectrum = np.fft.fft2(patch * taper)
            filtered = np.fft.ifft2(spectrum * np.abs(spectrum) ** alpha)
            y, x = max(i - lead - r0, 0), max(j - lead - c0, 0)
            y1, x1 = min(i - lead + step - r0, h), min(j - lead + step - c0, w)
            if y < y1 and x < x1:
                out[y:y1, x:x1] = filtered[y - (i - r0) + half : y1 - (i - r0) + half, x - (j - c0) + half : x1 - (j - c0) + half]
    size = _boxed(np.abs(out), window)
    coherence = np.divide(np.abs(_boxed(out, window)), size, out=np.zeros(z.shape), where=size > 0)
    length = np.abs(out)
    return np.divide(out * coherence, length, out=np.zeros_like(out), where=length > 0), coherence


def patch_filtered(image: DataFrame, shape: tuple[int, int], alpha: float = 0.5, nfft: int = 32, step: int | None = None, least: float = 0.7, beta: float = 2.12, window: np.ndarray | None = None, tile: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, re, im, coh) of complex images (by, row, col, re, im): the adaptive spectral filter by patches.

    Missing and null cells count as 0. Cells whose patch holds too few samples are null. A tile is one group, with
    a halo as wide as a patch and the window reach, so the result is the same for every size of tiles.
    """
    step = max(nfft // 8, 1) if step is None else step
    window = np.ones((7, 7)) if window is None else np.asarray(window, float)
    halo = nfft + step + window.shape[0]

    def kernel(dense: dict[str, np.ndarray], r0: int, c0: int) -> dict[str, np.ndarray]:
        z = np.nan_to_num(dense["re"]) + 1j * np.nan_to_num(dense["im"])
        out, coh = patch_filter(z, r0, c0, shape, alpha, nfft, step, least, beta, window)
        gone = out == 0
        return {"re": np.where(gone, np.nan, out.real), "im": np.where(gone, np.nan, out.imag), "coh": np.where(gone, np.nan, coh)}

    return by_tiles(image, shape, tile, halo, kernel, ("re", "im"), ("re", "im", "coh"), by)


def overlap_added(df: DataFrame, lines: int, block: int, hop: int, work: Callable[[DataFrame], DataFrame], value: str = "v") -> DataFrame:
    """(row, col, v) of work done on overlapping blocks of lines and added up under sine-squared weights.

    A line is copied to the blocks (block, row, col, v) that hold it, two where hop is half a block; work gives the same
    columns back. The outer halves of the first and the last block have full weight; weights are divided out. Lines behind the last
    whole block are left out, and missing cells stay so.
    """
    last = (lines - block) // hop
    low, high = F.greatest(F.lit(0), F.ceil((F.col("row") - block + 1) / hop)), F.least(F.lit(last), F.floor(F.col("row") / hop))
    dealt = df.where(F.col("row").between(0, last * hop + block - 1)).select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("block"), "row", "col", F.col(value).alias("v"))
    k = F.col("row") - F.col("block") * hop
    outer = ((F.col("block") == 0) & (k < block // 2)) | ((F.col("block") == last) & (k >= block // 2))
    weight = F.when(outer, 1.0).otherwise(F.pow(F.sin(math.pi * (k + 1) / (block + 1)), 2))
    return work(dealt).withColumn("w", weight).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def phase_noise(image: DataFrame, filtered: DataFrame) -> DataFrame:
    """One row (n, rms) of the phase that the filter took away, over cells that both have."""
    both = image.select("row", "col", F.col("re").alias("r1"), F.col("im").alias("i1")).join(filtered.where("re is not null").select("row", "col", F.col("re").alias("r2"), F.col("im").alias("i2")), ["row", "col"])
    d = F.atan2(F.col("i1") * F.col("r2") - F.col("r1") * F.col("i2"), F.col("r1") * F.col("r2") + F.col("i1") * F.col("i2"))
    return both.where("r1 <> 0 or i1 <> 0").agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rms"))
