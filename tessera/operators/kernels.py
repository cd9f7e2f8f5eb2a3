"""Global array kernels in numpy: spectra, fills, filters and solves of one grid, run per grid by apply_grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def to_grid(pdf: pd.DataFrame, value: str = "v") -> np.ndarray:
    """Long form to a dense array, NaN where missing."""
    out = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan)
    out[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf[value].to_numpy(dtype=float, na_value=np.nan)
    return out


def to_long(grid: np.ndarray, **keys) -> pd.DataFrame:
    r, c = np.indices(grid.shape)
    v = grid.ravel().astype(object)
    v[~np.isfinite(grid.ravel())] = None
    return pd.DataFrame({**{k: [x] * grid.size for k, x in keys.items()}, "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "v": v})


def apply_grids(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], by: str = "grid_id", value: str = "v") -> DataFrame:
    """(by, row, col, v) of kernel(grid) for every grid; a grid is one group and has to fit one executor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return to_long(kernel(to_grid(pdf, value)), **{by: pdf[by].iloc[0]})

    return df.select(by, "row", "col", value).groupBy(by).applyInPandas(run, f"{by} string, row int, col int, v double")


def lowpass(v: np.ndarray, sigma: Sequence[float], floor: float = 0.0) -> np.ndarray:
    """NaN-normalised Gaussian with mirrored edges, by FFT over a padded grid."""
    ok = np.isfinite(v)
    pads = [min(int(4 * s + 0.5), n) for s, n in zip(sigma, v.shape, strict=True)]

    def smooth(a):
        p = np.pad(a, [(k, k) for k in pads], mode="symmetric")
        f = np.fft.rfft2(p)
        ky, kx = np.fft.fftfreq(p.shape[0])[:, None], np.fft.rfftfreq(p.shape[1])
        f *= np.exp(-2 * np.pi**2 * ((sigma[0] * ky) ** 2 + (sigma[1] * kx) ** 2))
        q = np.fft.irfft2(f, p.shape)
        return q[pads[0] : pads[0] + v.shape[0], pads[1] : pads[1] + v.shape[1]]

    num, den = smooth(np.where(ok, v, 0.0)), smooth(ok.astype(float))
    return np.where(den > max(floor, 1e-9), num / np.maximum(den, 1e-12), np.nan)


def lowpass_flat(v: np.ndarray, sigma: Sequence[float], passes: int = 3, floor: float = 0.05) -> np.ndarray:
    """A low-pass whose pass band is flattened by filtering what is left, again and again."""
    out = lowpass(v, sigma, floor)
    for _ in range(passes - 1):
        out = out + np.nan_to_num(lowpass(v - out, sigma, floor))
    return out


def bilinear_at(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of weight * value, weight) of the known nodes around fractional places; nothing outside the grid."""
    ok = np.isfinite(v)
    z = np.where(ok, v, 0.0)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    num, den = np.zeros(y.shape), np.zeros(y.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            r, c = y0 + dy, x0 + dx
            w = (1 - np.abs(y - r)) * (1 - np.abs(x - c))
            inside = (r >= 0) & (r < v.shape[0]) & (c >= 0) & (c < v.shape[1])
            r, c = np.clip(r, 0, v.shape[0] - 1), np.clip(c, 0, v.shape[1] - 1)
            num += np.where(inside, w * z[r, c], 0)
            den += np.where(inside, w * ok[r, c], 0)
    return num, den


def rotated(v: np.ndarray, degrees: float, solid: float = 0.5) -> np.ndarray:
    """The grid turned about its centre, on a grid that holds all of it; places with less known weight are NaN."""
    t = np.radians(degrees)
    h, w = v.shape
    nh, nw = int(np.ceil(abs(h * np.cos(t)) + abs(w * np.sin(t)))), int(np.ceil(abs(w * np.cos(t)) + abs(h * np.sin(t))))
    y, x = np.indices((nh, nw)) - np.array([(nh - 1) / 2, (nw - 1) / 2])[:, None, None]
    num, den = bilinear_at(v, y * np.cos(t) - x * np.sin(t) + (h - 1) / 2, y * np.sin(t) + x * np.cos(t) + (w - 1) / 2)
    return np.where(den > solid, num / np.maximum(den, 1e-12), np.nan)


def interior(v: np.ndarray, least: int = 4096, fill: float = 0.15) -> np.ndarray | None:
    """The bounding box of the known cells; None if it is small or sparse."""
    ok = np.isfinite(v)
    if not ok.any():
        return None
    r, c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    box = v[r[0] : r[-1] + 1, c[0] : c[-1] + 1]
    return box if box.size >= least and np.isfinite(box).mean() >= fill else None


def spectrum(box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kx, ky, power) of the demeaned, Hann-weighted grid."""
    ok = np.isfinite(box)
    z = np.where(ok, box - box[ok].mean(), 0.0) * np.hanning(box.shape[0])[:, None] * np.hanning(box.shape[1])
    power = np.abs(np.fft.fft2(z)) ** 2
    ky, kx = np.meshgrid(np.fft.fftfreq(box.shape[0]), np.fft.fftfreq(box.shape[1]), indexing="ij")
    return kx, ky, power


def directionality(v: np.ndarray, sigma: float = 0.0, azimuth: float = 0.0, least: int = 4096) -> tuple[float, float, float]:
    """(R, theta, D_RA) of the texture: doubled-angle mean of the power in the annulus 3 / max(n) < k < 0.33; NaN if rejected.

    Rows run downwards, so the angle of a wave vector is atan2(-ky, kx); azimuth turns the grid first.
    """
    if sigma:
        v = lowpass(v, (sigma, sigma), 1e-3)
    if azimuth:
        v = rotated(v, azimuth)
    box = interior(v, least)
    if box is None:
        return (np.nan,) * 3
    kx, ky, power = spectrum(box)
    k = np.hypot(kx, ky)
    use = (k > 3 / max(box.shape)) & (k < 0.33)
    if use.sum() <= 64 or power[use].sum() == 0:
        return (np.nan,) * 3
    z = (power[use] * np.exp(2j * np.arctan2(-ky[use], kx[use]))).sum() / power[use].sum()
    theta = (np.degrees(np.angle(z)) / 2 + 180) % 180
    theta = theta - 180 if theta >= 90 else theta
    return abs(z), theta, abs(z) * np.cos(np.radians(2 * theta))


def band_tilt(v: np.ndarray, sigma: float = 28.0, least: float = 0.30, near: float = 10.0) -> float:
    """Orientation of the large-scale bands in degrees; 0 if weak or within `near` of an axis."""
    r, theta, _ = directionality(lowpass(v, (sigma, sigma)), least=64)
    axis = min(abs(theta), abs(abs(theta) - 90)) if np.isfinite(theta) else 0
    return 0.0 if not np.isfinite(r) or r < least or axis < near else float(theta)


def _dct(a: np.ndarray, axis: int, inverse: bool = False) -> np.ndarray:
    """Orthonormal DCT-II, or its inverse, by FFT."""
    a = np.moveaxis(a, axis, -1)
    n = a.shape[-1]
    k = np.arange(n)
    scale = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    turn = np.exp(-1j * np.pi * k / (2 * n))
    if not inverse:
        v = np.concatenate([a[..., ::2], a[..., 1::2][..., ::-1]], axis=-1)
        out = (np.fft.fft(v) * turn).real * scale
    else:
        c = a / scale
        # real part alone is known; the imaginary one mirrors it
        mirror = np.concatenate([np.zeros(c.shape[:-1] + (1,)), c[..., :0:-1]], axis=-1)
        v = np.fft.ifft((c - 1j * mirror) / turn).real
        out = np.empty_like(v)
        half = (n + 1) // 2
        out[..., ::2], out[..., 1::2] = v[..., :half], v[..., half:][..., ::-1]
    return np.moveaxis(out, -1, axis)


def dct2(a, inverse=False):
    return _dct(_dct(a, 0, inverse), 1, inverse)


def nearest_fill(v: np.ndarray) -> np.ndarray:
    """Holes take the value of a nearest known cell: column passes, then the lower envelope along rows."""
    ok = np.isfinite(v)
    if ok.all() or not ok.any():
        return v.copy()
    h, w = v.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(ok, rows, -(10**7)), axis=0)
    down = np.minimum.accumulate(np.where(ok, rows, 10**7)[::-1], axis=0)[::-1]
    src = np.where(rows - up <= down - rows, up, down)
    d2 = (src - rows).astype(float) ** 2
    cols = np.arange(w)
    best, pick = np.full((h, w), np.inf), np.zeros((h, w), int)
    for c in range(w):
        d = d2[:, c : c + 1] + (cols - c) ** 2
        better = d < best
        best, pick = np.where(better, d, best), np.where(better, c, pick)
    return v[np.clip(src[rows, pick], 0, h - 1), pick]


def pls_fill(y: np.ndarray, s: float | None = None, robust: int = 0, aniso: float = 1.0, iterations: int = 100, tol: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """(z, s, rejected): penalised least squares on a grid with holes, by relaxation in the cosine domain.

    The last axis' second difference weighs `aniso`; s is found by generalised cross-validation when None; robust
    passes reweight by Tukey's bisquare and reject what ends with weight 0.
    """
    ok = np.isfinite(y)
    z = nearest_fill(y)
    if not ok.any():
        return z, s or 1.0, np.zeros(y.shape, bool)
    y0 = np.where(ok, y, 0.0)
    lam = [-2 + 2 * np.cos(np.pi * np.arange(n) / n) for n in y.shape]
    lam2 = (lam[0][:, None] + aniso * lam[1]) ** 2
    weight, w = ok.astype(float), ok.astype(float)

    def score(p: float) -> float:
        g = 1 / (1 + 10**p * lam2)
        fit = dct2(g * dct2(w * (y0 - z) + z), True)
        rss = (w * (y0 - fit) ** 2).sum()
        return rss / ok.sum() / (1 - g.mean()) ** 2

    for step in range(robust + 1):
        for _ in range(iterations):
            if s is None:
                grid = np.linspace(-6, 6, 13)
                p = grid[np.argmin([score(x) for x in grid])]
                for width in (0.5, 0.25, 0.1):
                    near = p + width * np.array([-1, 0, 1])
                    p = near[np.argmin([score(x) for x in near])]
                s = 10**p
            g = 1 / (1 + s * lam2)
            new = dct2(g * dct2(w * (y0 - z) + z), True)
            change = np.linalg.norm(new - z) / max(np.linalg.norm(z), 1e-12)
            z = new
            if change < tol:
                break
        if step < robust:
            r = np.where(ok, y0 - z, 0.0)
            mad = np.median(np.abs(r[ok] - np.median(r[ok])))
            sigma = max(1.4826 * mad * np.sqrt(max(1 - g.mean(), 1e-9)), 1e-12)
            w = weight * np.maximum(1 - (r / (4.685 * sigma)) ** 2, 0) ** 2
    return z, s, ok & (w == 0)


def pls_multigrid(y: np.ndarray, s: float, levels: int = 3) -> np.ndarray:
    """Coarse solutions start finer ones: block means by 2, s falling by 16 for each level."""
    if levels == 0 or min(y.shape) < 16:
        return pls_fill(y, s)[0]
    h, w = y.shape[0] // 2 * 2, y.shape[1] // 2 * 2
    part = y[:h, :w].reshape(h // 2, 2, w // 2, 2)
    n = np.isfinite(part).sum(axis=(1, 3))
    coarse = np.where(n > 0, np.nansum(part, axis=(1, 3)) / np.maximum(n, 1), np.nan)
    up = pls_multigrid(coarse, s / 16, levels - 1)
    yy, xx = np.indices(y.shape)
    num, _ = bilinear_at(up, np.clip((yy - 0.5) / 2, 0, up.shape[0] - 1.000001), np.clip((xx - 0.5) / 2, 0, up.shape[1] - 1.000001))
    ok = np.isfinite(y)
    z = np.where(ok, y, num)
    lam = [-2 + 2 * np.cos(np.pi * np.arange(n) / n) for n in y.shape]
    g = 1 / (1 + s * (lam[0][:, None] + lam[1]) ** 2)
    for _ in range(20):
        z = dct2(g * dct2(np.where(ok, y, z)), True)
    return z


def oriented_fill(y: np.ndarray, s: float, aniso: float, theta: float) -> np.ndarray:
    """A fill that is smoother along a tilted axis; measured cells stay."""
    if not theta:
        z = pls_fill(y, s, aniso=aniso)[0]
    else:
        z = rotated(pls_fill(rotated(y, theta), s, aniso=aniso)[0], -theta, 0.99)
        r, c = (z.shape[0] - y.shape[0]) // 2, (z.shape[1] - y.shape[1]) // 2
        z = z[r : r + y.shape[0], c : c + y.shape[1]]
    return np.where(np.isfinite(y), y, np.where(np.isfinite(z), z, nearest_fill(y)))


def graph_fill(y: np.ndarray, eight: bool = False, iterations: int = 2000, tol: float = 1e-6) -> np.ndarray:
    """Harmonic fill by conjugate gradients on the Laplacian of the 4- or 8-neighbour graph; known cells are fixed."""
    ok = np.isfinite(y)
    if ok.all() or not ok.any():
        return y.copy()
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])

    def lap(a):
        out = np.zeros_like(a)
        for dy, dx in steps:
            p = (slice(0, -dy or None), slice(max(-dx, 0), -dx if dx > 0 else None))
            q = (slice(dy, None), slice(max(dx, 0), dx if dx < 0 else None))
            d = a[p] - a[q]
            out[p] += d
            out[q] -= d
        return out

    known = np.where(ok, y, 0.0)
    x = np.where(ok, 0.0, nearest_fill(y))
    r = np.where(ok, 0.0, -lap(known + x))
    p, rr = r.copy(), (r * r).sum()
    first = max(rr, 1e-30)
    for _ in range(iterations):
        if rr <= tol**2 * first:
            break
        ap = np.where(ok, 0.0, lap(p))
        a = rr / max((p * ap).sum(), 1e-30)
        x += a * p
        r -= a * ap
        new = (r * r).sum()
        p, rr = r + new / rr * p, new
    return known + x


def biharmonic_fill(y: np.ndarray) -> np.ndarray:
    """Thin-plate fill: penalised least squares with a penalty that leaves known cells as they are."""
    z = pls_fill(y, 1e-3, iterations=400, tol=1e-6)[0]
    return np.where(np.isfinite(y), y, z)


def _along(ok: np.ndarray, z: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps from each cell to the nearest known cell that lies (-dy, -dx) steps off, inf without one, and its value."""
    if dy == 0:
        steps, value = _along(ok.T, z.T, dx, dy)
        return steps.T, value.T
    (h, w), steps, value = ok.shape, np.full(ok.shape, np.inf), np.zeros(ok.shape)
    to, at = slice(max(dx, 0), w + min(dx, 0)), slice(max(-dx, 0), w - max(dx, 0))
    for r in range(1, h) if dy > 0 else range(h - 2, -1, -1):
        p = r - dy
        steps[r, to] = np.where(ok[p], 1, steps[p] + 1)[at]
        value[r, to] = np.where(ok[p], z[p], value[p])[at]
    return steps, value


def idw_fill(y: np.ndarray, smooth: int = 0, reach: int = 0) -> np.ndarray:
    """Inverse distance over the nearest known cell of each of the eight directions, with optional 3 x 3 means in holes.

    Without reach a direction is followed to the grid's edge, and cells that none serves take the nearest value.
    """
    ok = np.isfinite(y)
    num, den = np.zeros(y.shape), np.zeros(y.shape)
    z = np.where(ok, y, 0.0)
    for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)):
        steps, value = _along(ok, z, dy, dx)
        w = np.where(steps <= (reach or sum(y.shape)), 1 / (steps * np.hypot(dy, dx)), 0.0)
        num += w * value
        den += w
    out = np.where(ok, y, np.where(den > 0, num / np.maximum(den, 1e-12), np.nan))
    if not reach:
        out = np.where(np.isfinite(out), out, nearest_fill(y))
    for _ in range(smooth):
        out = np.where(ok, y, box3(out))
    return out


def box3(v: np.ndarray) -> np.ndarray:
    """Mean of the known cells of the 3 x 3 box."""
    p = np.pad(v, 1, constant_values=np.nan)
    parts = np.stack([p[a : a + v.shape[0], b : b + v.shape[1]] for a in range(3) for b in range(3)])
    n = np.isfinite(parts).sum(axis=0)
    return np.where(n > 0, np.nansum(parts, axis=0) / np.maximum(n, 1), np.nan)


def local_fill(y: np.ndarray, median: bool = False, rounds: int = 500) -> np.ndarray:
    out = y.copy()
    for _ in range(rounds):
        hole = ~np.isfinite(out)
        if not hole.any():
            break
        if median:
            p = np.pad(out, 1, constant_values=np.nan)
            parts = np.stack([p[a : a + y.shape[0], b : b + y.shape[1]] for a in range(3) for b in range(3)])
            some = np.isfinite(parts).any(axis=0)
            near = np.full(y.shape, np.nan)
            near[some] = np.nanmedian(parts[:, some], axis=0)
        else:
            near = box3(out)
        new = hole & np.isfinite(near)
        if not new.any():
            break
        out[new] = near[new]
    return out


def poly_fill(y: np.ndarray, order: int = 2, rounds: int = 3) -> np.ndarray:
    ok = np.isfinite(y)
    r, c = (a / max(n - 1, 1) for a, n in zip(np.indices(y.shape), y.shape, strict=True))
    terms = np.stack([r**a * c**b for a in range(order + 1) for b in range(order + 1 - a)], axis=-1)
    w, coef = np.ones(ok.sum()), None
    for _ in range(rounds):
        coef = np.linalg.lstsq(terms[ok] * w[:, None], y[ok] * w, rcond=None)[0]
        res = y[ok] - terms[ok] @ coef
        sigma = max(1.4826 * np.median(np.abs(res - np.median(res))), 1e-12)
        w = 1 / np.sqrt(1 + (res / (4.685 * sigma)) ** 2)
    return np.where(ok, y, terms @ coef)


def rbf_fill(y: np.ndarray, near: int = 64, most: int = 20000, seed: int = 0) -> np.ndarray:
    """Thin-plate splines through the nearest known cells of each hole; known cells are a seeded sample if there are many."""
    ok, hole = np.argwhere(np.isfinite(y)), np.argwhere(~np.isfinite(y))
    if len(ok) > most:
        ok = ok[np.sort(np.random.default_rng(seed).choice(len(ok), most, replace=False))]
    out = y.copy()
    kernel = lambda d2: np.where(d2 > 0, 0.5 * d2 * np.log(np.maximum(d2, 1e-30)), 0.0)
    for h in hole:
        d2 = ((ok - h) ** 2).sum(axis=1)
        k = np.argpartition(d2, min(near, len(ok)) - 1)[:near]
        p = ok[k].astype(float)
        a = kernel(((p[:, None] - p) ** 2).sum(axis=2))
        lin = np.concatenate([np.ones((len(p), 1)), p], axis=1)
        m = np.block([[a, lin], [lin.T, np.zeros((3, 3))]])
        sol = np.linalg.lstsq(m, np.concatenate([y[tuple(ok[k].T)], np.zeros(3)]), rcond=None)[0]
        out[tuple(h)] = kernel(((p - h) ** 2).sum(axis=1)) @ sol[:-3] + sol[-3] + sol[-2] * h[0] + sol[-1] * h[1]
    return out


def griddata_fill(y: np.ndarray, cubic: bool = False) -> np.ndarray:
    """Piecewise linear between known cells of each row and column, averaged by distance; cubic smooths it in holes."""
    out, weight = np.zeros(y.shape), np.zeros(y.shape)
    for axis in (0, 1):
        a = np.moveaxis(y, axis, 1)
        for r in range(a.shape[0]):
            known = np.flatnonzero(np.isfinite(a[r]))
            if len(known) < 2:
                continue
            at = np.arange(known[0], known[-1] + 1)
            right = np.clip(np.searchsorted(known, at), 1, len(known) - 1)
            gap = known[right] - known[right - 1]
            where = (np.full(len(at), r), at) if axis == 1 else (at, np.full(len(at), r))
            out[where] += np.interp(at, known, a[r, known]) / gap
            weight[where] += 1 / gap
    z = np.where(np.isfinite(y), y, np.where(weight > 0, out / np.maximum(weight, 1e-12), nearest_fill(y)))
    return biharmonic_fill(np.where(np.isfinite(y) | (weight == 0), z, np.nan)) if cubic else z


#: Fill methods by name; each takes a grid with NaN holes and options, and never changes a measured cell.
FILLS: dict[str, Callable[..., np.ndarray]] = {
    "pls": lambda y, s=1.0, aniso=1.0, **k: np.where(np.isfinite(y), y, pls_fill(y, s, aniso=aniso, **k)[0]),
    "pls_mg": lambda y, s=1.0, **k: np.where(np.isfinite(y), y, pls_multigrid(y, s, **k)),
    "laplace": lambda y, **k: graph_fill(y, False, **k),
    "spring": lambda y, **k: graph_fill(y, True, **k),
    "biharmonic": lambda y: biharmonic_fill(y),
    "idw": lambda y, **k: idw_fill(y, 0, **k),
    "idw_smooth": lambda y, **k: idw_fill(y, 3, **k),
    "local": lambda y, **k: local_fill(y, False, **k),
    "median_grow": lambda y, **k: local_fill(y, True, **k),
    "nearest": lambda y: nearest_fill(y),
    "griddata": lambda y: griddata_fill(y),
    "griddata_cubic": lambda y: griddata_fill(y, True),
    "poly": lambda y, **k: poly_fill(y, **k),
    "rbf": lambda y, **k: rbf_fill(y, **k),
}


def fill(y: np.ndarray, method: str, **options) -> np.ndarray:
    if method not in FILLS:
        raise ValueError(f"no fill method {method!r}; there are {', '.join(FILLS)}")
    return FILLS[method](np.asarray(y, float), **options)


def kaiser(n: int, beta: float = 2.12) -> np.ndarray:
    return np.kaiser(n, beta)


def triangle_weights(n: int) -> np.ndarray:
    t = 1 - np.abs(np.arange(n) - (n - 1) / 2) / ((n + 1) / 2)
    return t[:, None] * t


def goldstein(z: np.ndarray, alpha: float = 0.6, nfft: int = 32, step: int = 8, least: float = 0.7) -> np.ndarray:
    """Adaptive phase filter: every step x step block comes from the centre of its own Kaiser-weighted patch, whose
    spectrum is multiplied by its power to alpha / 2. Patches with too few samples give 0. Unit phasors times |z|."""
    pad = nfft // 2
    p = np.pad(z, pad + step)
    out = np.zeros_like(z)
    win = np.outer(kaiser(nfft), kaiser(nfft))
    off = (nfft - step) // 2
    for r in range(0, z.shape[0], step):
        for c in range(0, z.shape[1], step):
            a, b = r + pad + step - off, c + pad + step - off
            patch = p[a : a + nfft, b : b + nfft]
            if np.count_nonzero(patch) < least * patch.size:
                continue
            f = np.fft.fft2(patch * win)
            f *= np.abs(f) ** alpha
            g = np.fft.ifft2(f)[off : off + step, off : off + step]
            h, w = out[r : r + step, c : c + step].shape
            out[r : r + step, c : c + step] = np.exp(1j * np.angle(g[:h, :w]))
    return np.abs(z) * out


def integrate_rows(g: np.ndarray, cut_rows: float = 0.0) -> np.ndarray:
    """Integral down the rows: a running sum, or Tikhonov in the spectrum of the odd extension when cut_rows > 0."""
    if not cut_rows:
        return np.cumsum(g, axis=0)
    ext = np.concatenate([g, -g[::-1]], axis=0)
    k = np.fft.fftfreq(len(ext))[:, None]
    d = 1 - np.exp(-2j * np.pi * k)
    mu = 2 * np.pi / cut_rows
    h = np.conj(d) / (np.abs(d) ** 2 + mu**2)
    return np.fft.ifft(np.fft.fft(ext, axis=0) * h, axis=0).real[: len(g)]


def poisson(gy: np.ndarray, gx: np.ndarray, wy: np.ndarray, wx: np.ndarray, iterations: int = 400, tol: float = 1e-6) -> np.ndarray:
    """The zero-mean surface with weighted differences gy (h - 1, w) and gx (h, w - 1): conjugate gradients with a cosine
    preconditioner of the unweighted operator."""
    h, w = gx.shape[0], gy.shape[1]

    def diff(p):
        return p[1:] - p[:-1], p[:, 1:] - p[:, :-1]

    def adjoint(a, b):
        out = np.zeros((h, w))
        out[1:] += a
        out[:-1] -= a
        out[:, 1:] += b
        out[:, :-1] -= b
        return out

    lam = (2 - 2 * np.cos(np.pi * np.arange(h) / h))[:, None] + 2 - 2 * np.cos(np.pi * np.arange(w) / w)
    lam[0, 0] = 1.0

    def pre(r):
        c = dct2(r) / lam
        c[0, 0] = 0.0
        return dct2(c, True)

    r = adjoint(wy * gy, wx * gx)
    x = np.zeros((h, w))
    z = pre(r)
    p, rz, first = z.copy(), (r * z).sum(), max(np.linalg.norm(r), 1e-30)
    for _ in range(iterations):
        if np.linalg.norm(r) <= tol * first:
            break
        a, b = diff(p)
        ap = adjoint(wy * a, wx * b)
        k = rz / max((p * ap).sum(), 1e-30)
        x += k * p
        r -= k * ap
        z = pre(r)
        new = (r * z).sum()
        p, rz = z + new / rz * p, new
    return x - x.mean()


def unwrap(phase: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Least-squares unwrapping, made congruent: the wrapped phase plus whole turns nearest to the solution; NaN stays."""
    ok = np.isfinite(phase)
    p = np.where(ok, phase, 0.0)
    w = np.where(ok, 1.0 if weight is None else weight, 0.0) + 1e-6
    wrap = lambda a: np.angle(np.exp(1j * a))
    smooth = poisson(wrap(np.diff(p, axis=0)), wrap(np.diff(p, axis=1)), np.minimum(w[1:], w[:-1]), np.minimum(w[:, 1:], w[:, :-1]))
    shift = np.angle(np.exp(1j * (p - smooth))[ok].mean()) if ok.any() else 0.0
    smooth = smooth + shift
    return np.where(ok, p + 2 * np.pi * np.rint((smooth - p) / (2 * np.pi)), np.nan)


def match_offset(ref: np.ndarray, sec: np.ndarray, search: int) -> tuple[float, float, float]:
    """(row, col, snr) shift of a window of sec against ref by normalised cross-correlation with a parabolic peak.

    ref is the window; sec is larger by `search` cells on every side.
    """
    h, w = ref.shape
    a = np.abs(ref) - np.abs(ref).mean()
    b = np.abs(sec)
    size = (b.shape[0] + h, b.shape[1] + w)
    cross = np.fft.irfft2(np.fft.rfft2(b, size) * np.conj(np.fft.rfft2(a, size)), size)[: 2 * search + 1, : 2 * search + 1]
    sums = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    box = lambda s: s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]
    mean, square = box(sums(b)) / (h * w), box(sums(b * b))
    var = np.maximum(square - h * w * mean**2, 1e-12)[: 2 * search + 1, : 2 * search + 1]
    ncc = cross / np.sqrt(var * max((a * a).sum(), 1e-12))
    r, c = np.unravel_index(np.argmax(ncc), ncc.shape)

    def vertex(v, k):
        if not 0 < k < len(v) - 1:
            return float(k)
        d = v[k - 1] - 2 * v[k] + v[k + 1]
        return k + (0.5 * (v[k - 1] - v[k + 1]) / d if d else 0.0)

    rest = np.delete(ncc.ravel() ** 2, r * ncc.shape[1] + c)
    return vertex(ncc[:, c], r) - search, vertex(ncc[r], c) - search, float(ncc[r, c] ** 2 / max(rest.mean(), 1e-12))


def refocus_block(block: np.ndarray, shift: Callable[[np.ndarray], np.ndarray], prf: float, carrier: float = 0.0) -> np.ndarray:
    """A block of lines with a Doppler-dependent along-track shift (lines, by frequency) applied in its spectrum.

    The phase is 2 pi / prf times the integral of the shift over frequency, 0 at frequency 0, without its mean slope,
    so that the block as a whole stays where it is.
    """
    n = len(block)
    line = np.arange(n)[:, None]
    base = block * np.exp(-2j * np.pi * carrier / prf * line)
    f = np.fft.fftshift(np.fft.fftfreq(n, 1 / prf))
    s = shift(f)
    s = s - s.mean()
    area = np.concatenate([[0.0], np.cumsum(0.5 * (s[1:] + s[:-1]) * np.diff(f))])
    area -= np.interp(0.0, f, area)
    phase = np.fft.ifftshift(2 * np.pi / prf * area)[:, None]
    return np.fft.ifft(np.fft.fft(base, axis=0) * np.exp(1j * phase), axis=0) * np.exp(2j * np.pi * carrier / prf * line)


def refocus(image: np.ndarray, shift: Callable[[float, np.ndarray], np.ndarray], prf: float, carrier: float = 0.0, block: int = 240, hop: int = 120) -> np.ndarray:
    """Overlap-add of refocused blocks with Hann weights that are flat at the outer ends; shift(centre line, f)."""
    n = len(image)
    starts = sorted({*range(0, max(n - block, 0) + 1, hop), max(n - block, 0)})
    out, weight = np.zeros_like(image, dtype=complex), np.zeros((n, 1))
    for a in starts:
        part = image[a : a + block]
        w = np.hanning(len(part) + 2)[1:-1]
        half = len(part) // 2
        if a == starts[0]:
            w[:half] = 1.0
        if a == starts[-1]:
            w[half:] = 1.0
        out[a : a + block] += w[:, None] * refocus_block(part, lambda f, a=a, m=len(part): shift(a + m / 2, f), prf, carrier)
        weight[a : a + block] += w[:, None]
    return out / weight


def screen_sigma(noise: float, shape: tuple[int, int], pipeline: Callable[[np.ndarray], np.ndarray], runs: int = 32, seed: int = 0) -> np.ndarray:
    """Standard deviation by cell of a pipeline over `runs` draws of white noise; one pass of sums."""
    rng = np.random.default_rng(seed)
    s1, s2 = np.zeros(shape), np.zeros(shape)
    for _ in range(runs):
        x = pipeline(rng.normal(0, noise, shape))
        s1 += x
        s2 += x * x
    return np.sqrt(np.maximum((s2 / runs - (s1 / runs) ** 2) * runs / (runs - 1), 0))


def utm(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing on the WGS84 ellipsoid by the sixth-order series in the third flattening."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    phi, lam = np.radians(lat), np.radians(np.asarray(lon) - (6 * zone - 183))
    e = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(c * np.cos(2 * (k + 1) * xi) * np.sinh(2 * (k + 1) * eta) for k, c in enumerate(alpha))
    y = xi + sum(c * np.sin(2 * (k + 1) * xi) * np.cosh(2 * (k + 1) * eta) for k, c in enumerate(alpha))
    return 500000 + 0.9996 * big * x, 0.9996 * big * y + (10000000 if south else 0)
