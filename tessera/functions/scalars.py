"""Column functions: angles, complex numbers, radar geometry, names and dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed physical values.
C_LIGHT = 299792458.0
K_TEC = 40.31
#: Fixed radar values: carriers in Hz, bandwidths in Hz, azimuth bandwidth in Hz, resolutions in m.
RADAR = {"fc_A": 1239000000.0, "fc_B": 1293500000.0, "bw_A": 40000000.0, "bw_B": 5000000.0, "azbw": 1262.98}
RHO_AZ = 5.347
DEG = 180.0 / math.pi


def q(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def pmod(a: Column, b) -> Column:
    """Floor modulo, also of doubles."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return a - F.floor(a / b) * b


def wrap(x: Column) -> Column:
    """The angle in (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def angdiff180(a: Column, b: Column) -> Column:
    """Difference of orientations in degrees, in [-90, 90)."""
    return pmod(a - b + 90, 180) - 90


def bearing(vx: Column, vy: Column) -> Column:
    """Degrees from +y towards +x."""
    return F.atan2(vx, vy) * F.lit(DEG)


def loss_field(r: Column) -> Column:
    """max(-r, 0); null stays null, which greatest() alone would skip."""
    return F.when(r.isNotNull(), F.greatest(-r, F.lit(0.0)))


def fold_frequency(f: Column, prf) -> Column:
    return pmod(f + prf / 2, prf) - prf / 2


def implied_height(a: Column, wavelength, slant, beam, speed, height) -> Column:
    """Height of the layer from an along-track lag a: a over the synthetic aperture, times the platform height."""
    aperture = wavelength * slant * beam / (2 * speed)
    return a / aperture * height


def pierce_fraction(slant: Column, satellite, ground, shell_m) -> Column:
    """kappa = 1 - t, where the ray of a slant range crosses the shell: the root of the quadratic in t.

    satellite and ground are distances to the earth's centre. Null where the ray misses the shell.
    """
    rs2, rt2 = satellite * satellite, ground * ground
    a = slant * slant
    b = (rs2 + rt2 - a) / 2 - rs2
    c = rs2 - (ground + shell_m) * (ground + shell_m)
    disc = b * b - a * c
    return F.when(disc >= 0, 1 - (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / a)


def phase_rate(v: Column, wavelength, slant) -> Column:
    """Along-track phase gradient of an azimuth shift in metres; the sign is part of the convention."""
    return F.lit(-4 * math.pi) * v / (wavelength * slant)


def split_determinant(f0: float, f1: float) -> float:
    return (f0 - f1) / f0 - (f1 - f0) / f1


def split_solve(phi0: Column, diff: Column, f0: float, f1: float) -> tuple[Column, Column]:
    """(dispersive, non-dispersive) phase at f0 from the phase there and the band difference phi0 - phi1.

    phi0 = n + d and phi1 = n f1 / f0 + d f0 / f1.
    """
    a11, a12, a21, a22 = 1.0, 1.0, (f0 - f1) / f0, (f1 - f0) / f1
    det = a11 * a22 - a12 * a21
    return (F.lit(a11) * diff - F.lit(a21) * phi0) / det, (F.lit(a22) * phi0 - F.lit(a12) * diff) / det


def attribution(f0: float, f1: float) -> tuple[float, float]:
    """Coefficients of phi0 and of the difference in the dispersive phase; the two terms add up to it."""
    det = split_determinant(f0, f1)
    return (f0 - f1) / f0 / det, -1.0 / det


def rotate(re: Column, im: Column, phi: Column) -> tuple[Column, Column]:
    """(re, im) times exp(j phi)."""
    return re * F.cos(phi) - im * F.sin(phi), re * F.sin(phi) + im * F.cos(phi)


def times_conj(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return ar * br + ai * bi, ai * br - ar * bi


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(x))


def log_floor(x: Column, floor: float = 1e-6) -> Column:
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(floor))))


def nodata_null(x: Column, nodata: float | None) -> Column:
    """Nodata and non-finite values as null."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~(bad if nodata is None else bad | (x == nodata)), x)


def lattice_shape(n: Column, window, search, skip) -> Column:
    """Windows along an axis of n samples; null where none fits."""
    k = F.floor((n - window - 2 * search) / skip)
    return F.when(k >= 1, k)


def node_pixel(k: Column, search, window, skip) -> Column:
    return search + F.floor(F.lit(window) / 2) + skip * k


def penalty(cutoff: Column) -> Column:
    """Smoothing weight whose half response lies at the cutoff, in cells."""
    return F.pow(cutoff / F.lit(2 * math.pi), 4)


def range_looks(metres, spacing: Column) -> Column:
    """Looks that cover `metres`, half to even, one at least."""
    return F.greatest(F.lit(1.0), F.rint(metres / spacing))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """UTM zone code; polar stereographic beyond 84 north and 80 south belongs to polar_epsg."""
    zone = F.floor((lon + 180) / 6) + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def polar_epsg(lon: Column, lat: Column, beyond: float = 60.0) -> Column:
    return F.when(lat > beyond, F.lit(3413)).when(lat < -beyond, F.lit(3031)).otherwise(utm_epsg(lon, lat))


def cell_centre(origin, k: Column, step) -> Column:
    """Centre of cell k of an axis whose first centre lies half a step inside origin's cell edge."""
    return origin - step / 2 + (k + 0.5) * step


def compact_date(s: Column) -> Column:
    """YYYYMMDD from a name with a date, or null."""
    part = lambda k: F.regexp_extract(s, r"(\d{4})-?(\d{2})-?(\d{2})", k)
    return F.when(part(1) != "", F.concat(part(1), part(2), part(3)))


def track_number(s: Column) -> Column:
    part = F.regexp_extract(s, r"_t0*(\d+)[_-]", 1)
    return F.when(part != "", part.cast("int"))


def pair_tag(ref: Column, sec: Column) -> Column:
    """Tag of a pair by the dates in both names, else ref_sec."""
    a, b = compact_date(ref), compact_date(sec)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("_", a, b)).otherwise(F.lit("ref_sec"))


def day_after(s: Column) -> Column:
    """The calendar day after a YYYYMMDD string, as YYYY-MM-DD."""
    return F.date_format(F.date_add(F.to_date(s, "yyyyMMdd"), 1), "yyyy-MM-dd")


#: Fixed name prefixes, tried in this order.
STYLES = (
    ("unwrapped", ("ifg_unw", "ifg_phase_unw", "unw_", "phi_a_unw", "phi_diff_unw", "nondisp")),
    ("wrapped", ("ifg_phase_raw", "ifg_phase_corrected", "ifg_phase", "filt_ifg_phase", "ifg_gslc_phase", "phi_diff_ms", "phi_diff")),
    ("coherence", ("coh_", "coherence", "ifg_coh", "ifg_gslc_coh", "mai_coh")),
    ("positive", ("iono_screen_sigma", "mai_screen_sigma")),
)


def style_of(name: Column) -> Column:
    out = None
    for kind, prefixes in STYLES:
        hit = None
        for p in prefixes:
            hit = name.startswith(p) if hit is None else hit | name.startswith(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("signed")
