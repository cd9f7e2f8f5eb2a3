"""Radar geometry as column plans: orbit states, radar to ground over a height model, ground to radar, geocoding.

Places of the radar image are zero-Doppler: a point is seen at the time when the line to the satellite stands across the
velocity. Orbits are cubic Hermite curves through evenly spaced states. Every step is a column of JVM code; heights and
image values come from a join on tiles that overlap by as much as a point can move or an interpolator reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir

from .fixpoint import cut, discard
from .tiling import at_place, tile_arrays

STATE = ("t", "x", "y", "z", "vx", "vy", "vz")
XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    b: float

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2


WGS84 = Ellipsoid(6378137.0, 6356752.314245179)


@dataclass(frozen=True)
class RadarGrid:
    """Time of the first line, lines a second, range of the first sample, metres a sample, side, size."""

    sensing_start: float
    prf: float
    starting_range: float
    range_spacing: float
    lookside: str
    rows: int
    cols: int

    @classmethod
    def of(cls, radar: DataFrame) -> RadarGrid:
        """The grid of a granule's one row of radar constants."""
        r = radar.first()
        return cls(r.sensing_start, r.prf, r.starting_range, r.range_spacing, r.lookside, r.rows, r.cols)

    def looked(self, looks: tuple[int, int]) -> RadarGrid:
        """The grid of boxes of looks; a box lies at the centre of its lines and samples."""
        la, lr = looks
        return RadarGrid(self.sensing_start + (la - 1) / 2 / self.prf, self.prf / la, self.starting_range + (lr - 1) / 2 * self.range_spacing, self.range_spacing * lr, self.lookside, self.rows // la, self.cols // lr)


@dataclass(frozen=True)
class Heights:
    """A height model (row, col, v) on a grid of degrees: its corner cell's longitude and latitude, steps (dy < 0) and shape.
    Values stand at the cells' own places."""

    cells: DataFrame
    lon: float
    lat: float
    dx: float
    dy: float
    shape: tuple[int, int]

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return (lat - self.lat) / self.dy, (lon - self.lon) / self.dx


def orbit_of(states: DataFrame) -> DataFrame:
    """One row with the states (STATE) as an array in order of time. Fewer than two, or uneven steps, are an error.

    An orbit has some dozens of states, whatever the size of the image.
    """
    one = states.agg(F.sort_array(F.collect_list(F.struct(*STATE))).alias("o_orbit"))
    n = F.size("o_orbit")
    first, last = F.element_at("o_orbit", 1)["t"], F.element_at("o_orbit", -1)["t"]
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("o_orbit", i)["t"] - F.get("o_orbit", i - 1)["t"])
    even = F.forall(steps, lambda s: F.abs(s * (n - 1) / (last - first) - 1) < 1e-6)
    fault = F.raise_error(F.lit("an orbit has two states or more at even steps")).cast("array<struct<t:double,x:double,y:double,z:double,vx:double,vy:double,vz:double>>")
    return one.select(F.when(n < 2, fault).when(~even, fault).otherwise(F.col("o_orbit")).alias("o_orbit"))


def _state(df: DataFrame, t: Column) -> DataFrame:
    """df (o_orbit, ...) with o_t, position o_x.., velocity o_vx.. and acceleration o_ax.. at the time t."""
    orbit = F.col("o_orbit")
    n = F.size(orbit)
    first, last = F.get(orbit, F.lit(0))["t"], F.get(orbit, n - 1)["t"]
    df = df.withColumn("o_t", t)
    df = df.withColumn("o_k", F.greatest(F.lit(0), F.least(F.floor((F.col("o_t") - first) / ((last - first) / (n - 1))), n - 2)).cast("int"))
    df = df.withColumns({"o_p": F.get(orbit, F.col("o_k")), "o_q": F.get(orbit, F.col("o_k") + 1)})
    h = F.col("o_q.t") - F.col("o_p.t")
    df = df.withColumns({"o_h": h, "o_u": (F.col("o_t") - F.col("o_p.t")) / h})
    u, h, new = F.col("o_u"), F.col("o_h"), {}
    for c in XYZ:
        ends = (F.col(f"o_p.{c}"), F.col(f"o_p.v{c}") * h, F.col(f"o_q.{c}"), F.col(f"o_q.v{c}") * h)
        mix = lambda *w, ends=ends: sum(x * e for x, e in zip(w[1:], ends[1:], strict=True)) + w[0] * ends[0]
        new[f"o_{c}"] = mix((2 * u - 3) * u * u + 1, ((u - 2) * u + 1) * u, (3 - 2 * u) * u * u, (u - 1) * u * u)
        new[f"o_v{c}"] = mix(6 * (u - 1) * u, (3 * u - 4) * u + 1, 6 * (1 - u) * u, (3 * u - 2) * u) / h
        new[f"o_a{c}"] = mix(12 * u - 6, 6 * u - 4, 6 - 12 * u, 6 * u - 2) / (h * h)
    return df.withColumns(new)


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _three(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in XYZ]


def to_xyz(lon: Column, lat: Column, height: Column, body: Ellipsoid = WGS84) -> list[Column]:
    """Cartesian metres of degrees and metres."""
    lam, phi = F.radians(lon), F.radians(lat)
    n = body.a / F.sqrt(1 - body.e2 * F.sin(phi) * F.sin(phi))
    return [(n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - body.e2) + height) * F.sin(phi)]


def _ground(df: DataFrame, body: Ellipsoid) -> DataFrame:
    """df (g_x, g_y, g_z) with lon, lat (degrees) and g_h, the height over the body."""
    x, y, z = _three("g_")
    second = body.a * body.e2, body.b * body.e2 / (1 - body.e2)
    df = df.withColumns({"g_p": F.sqrt(x * x + y * y)}).withColumn("g_b", F.atan2(z * body.a, F.col("g_p") * body.b))
    sin, cos = F.sin("g_b"), F.cos("g_b")
    df = df.withColumn("g_phi", F.atan2(z + second[1] * sin * sin * sin, F.col("g_p") - second[0] * cos * cos * cos))
    sin, cos = F.sin("g_phi"), F.cos("g_phi")
    height = F.col("g_p") * cos + z * sin - body.a * F.sqrt(1 - body.e2 * sin * sin)
    return df.withColumns({"g_h": height, "lon": F.degrees(F.atan2(y, x)), "lat": F.degrees("g_phi")})


def _sighted(df: DataFrame, body: Ellipsoid) -> DataFrame:
    """The ground point at range g_r and distance g_rt from the centre: closed form in the plane across the velocity."""
    cos = (F.col("g_s2") + F.col("g_r") * F.col("g_r") - F.col("g_rt") * F.col("g_rt")) / (2 * F.col("g_r") * F.col("g_sp"))
    df = df.withColumn("g_cos", F.when(F.abs(cos) <= 1, cos)).withColumn("g_sin", F.sqrt(1 - F.col("g_cos") * F.col("g_cos")))
    return _ground(df.withColumns({f"g_{c}": F.col(f"o_{c}") + F.col("g_r") * (F.col("g_cos") * F.col(f"g_d{c}") + F.col("g_sin") * F.col(f"g_e{c}")) for c in XYZ}), body)


#: What the rounds go on with.
_SIGHT = ["g_r", "g_s2", "g_sp", "g_rt", "g_want", "g_h", "lon", "lat", *[f"{p}{c}" for p in ("o_", "g_d", "g_e", "g_") for c in XYZ]]


def _settling(df: DataFrame, height: Column, body: Ellipsoid, rounds: int, keep: list[str]) -> DataFrame:
    """Moves g_rt by what the ground point lies off the wanted height, which may depend on the point, round after round. Each
    round keeps its own columns only, as the optimizer would carry what it knows of all others from round to round."""
    for _ in range(rounds):
        df = df.withColumn("g_want", height)
        df = _sighted(df.withColumn("g_rt", F.col("g_rt") + F.col("g_want") - F.col("g_h")), body).select(*keep, *_SIGHT)
    return df.withColumn("g_want", height).select(*keep, *_SIGHT)


def forward(points: DataFrame, states: DataFrame, grid: RadarGrid, surface: float | str | Heights = 0.0, body: Ellipsoid = WGS84, rounds: int = 4, tolerance: float = 0.01, least_incidence: float = 15.0, tile: int = 128, passes: int = 8) -> DataFrame:
    """points (row, col, ...) with x, y, z (metres), lon, lat (degrees) and height of the ground that they show.

    surface is a height, a column of heights, or a height model. Over a model, rounds over the mean height come first; then
    each pass joins the points to the model's tiles, whose halo is as wide as heights can move a point from there at the
    least incidence, makes some rounds inside the tile and is written; passes go on until every point has met its
    height to the tolerance (metres), `passes` at most. Null where a range doesn't reach the ground, outside
    the model, at its gaps, where the heights still aren't met (steep slopes that face the radar), and for null rows, columns
    or heights. No rows give no rows.
    """
    names = [c for c in points.columns if c not in (*XYZ, "lon", "lat", "height")]
    start = points.select(*names)
    # one row
    df = _state(start.crossJoin(F.broadcast(orbit_of(states))), F.lit(grid.sensing_start) + F.col("row") / grid.prf)
    side = 1.0 if grid.lookside.lower().startswith("r") else -1.0
    s, v = _three("o_"), _three("o_v")
    df = df.withColumns({"g_r": F.lit(grid.starting_range) + F.col("col") * grid.range_spacing, "g_s2": _dot(s, s), "g_vv": F.sqrt(_dot(v, v))})
    df = df.withColumns({f"g_u{c}": F.col(f"o_v{c}") / F.col("g_vv") for c in XYZ})
    df = df.withColumn("g_su", _dot(s, _three("g_u")))
    df = df.withColumns({f"g_d{c}": F.col("g_su") * F.col(f"g_u{c}") - F.col(f"o_{c}") for c in XYZ})
    df = df.withColumn("g_sp", F.sqrt(_dot(_three("g_d"), _three("g_d"))))
    df = df.withColumns({f"g_d{c}": F.col(f"g_d{c}") / F.col("g_sp") for c in XYZ})
    d, u = _three("g_d"), _three("g_u")
    across = [d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0]]
    df = df.withColumns({f"g_e{c}": side * a for c, a in zip(XYZ, across, strict=True)})
    model = isinstance(surface, Heights)
    if model:
        low, high, mean = surface.cells.agg(F.min("v"), F.max("v"), F.avg("v")).first()
        flat = F.lit(float(mean or 0.0))
    else:
        flat = F.col(surface).cast("double") if isinstance(surface, str) else F.lit(float(surface))
    df = _sighted(df.withColumn("g_rt", F.lit(body.a) + flat).withColumn("g_want", flat), body).select(*names, *_SIGHT)
    df = _settling(df, flat, body, rounds, names)
    if model and low is not None:
        shared_dir(points.sparkSession)
        reach = max(high - mean, mean - low) / math.tan(math.radians(least_incidence))
        lat_far = min(89.9, max(abs(surface.lat), abs(surface.lat + surface.dy * surface.shape[0])))
        each = math.radians(min(abs(surface.dy), abs(surface.dx) * math.cos(math.radians(lat_far)))) * body.b
        halo = math.ceil(reach / each) + 2
        size = max(tile, 2 * halo)
        tiles = tile_arrays(surface.cells, surface.shape, size, halo, ["v"])
        tiles = cut(tiles.select(*[F.col(c).alias(f"m_{c}") for c in ("ty", "tx", "r0", "c0", "w", "v")]))
        tile_of = lambda at, n: F.greatest(F.lit(0), F.least(F.lit((n - 1) // size), F.floor(at / size))).cast("int")
        wanted = surface.place(F.col("lon"), F.col("lat"))
        now = cut(df)
        for _ in range(passes):
            placed = now.withColumns({"g_ty": tile_of(wanted[0], surface.shape[0]), "g_tx": tile_of(wanted[1], surface.shape[1])})
            both = placed.join(tiles, (F.col("g_ty") == F.col("m_ty")) & (F.col("g_tx") == F.col("m_tx")), "left")
            tile_columns = ["m_r0", "m_c0", "m_w", "m_v"]
            before, now = now, cut(_settling(both, at_place(F.col("m_v"), *wanted, surface.shape, "m_"), body, rounds, [*names, *tile_columns]).drop(*tile_columns))
            discard(before)
            if now.where(F.abs(F.col("g_want") - F.col("g_h")) > tolerance).isEmpty():
                break
        discard(tiles)
        df = now
    elif model:
        df = df.withColumn("g_want", F.lit(None).cast("double"))
    met = F.abs(F.col("g_want") - F.col("g_h")) <= tolerance
    return df.select(*names, *[F.when(met, F.col(f"g_{c}")).alias(c) for c in XYZ], *[F.when(met, F.col(c)).alias(c) for c in ("lon", "lat")], F.when(met, F.col("g_h")).alias("height"))


def inverse(points: DataFrame, states: DataFrame, grid: RadarGrid, rounds: int = 5, tolerance: float = 1e-8) -> DataFrame:
    """points (x, y, z, ...) with az and rg, the line and sample at which they are seen, by Newton steps from mid-orbit.

    Null where the steps don't settle to the tolerance (seconds), outside the orbit's times, and for null places. Places
    outside the image have lines and samples outside of it.
    """
    names = [c for c in points.columns if c not in ("az", "rg")]
    orbit = F.col("o_orbit")
    ends = F.get(orbit, F.lit(0))["t"], F.get(orbit, F.size(orbit) - 1)["t"]
    # one row
    df = points.select(*names).crossJoin(F.broadcast(orbit_of(states)))
    t = (ends[0] + ends[1]) / 2
    for _ in range(rounds):
        df = _state(df, t)
        line = [F.col(c) - F.col(f"o_{c}") for c in XYZ]
        df = df.withColumn("o_step", _dot(line, _three("o_v")) / (_dot(line, _three("o_a")) - _dot(_three("o_v"), _three("o_v"))))
        t = F.col("o_t") - F.col("o_step")
    df = _state(df.withColumn("o_last", F.abs(F.col("o_step"))), t)
    line = [F.col(c) - F.col(f"o_{c}") for c in XYZ]
    fine = (F.col("o_last") <= tolerance) & F.col("o_t").between(*ends)
    return df.select(*names, F.when(fine, (F.col("o_t") - grid.sensing_start) * grid.prf).alias("az"), F.when(fine, (F.sqrt(_dot(line, line)) - grid.starting_range) / grid.range_spacing).alias("rg"))


def geocoded(cells: DataFrame, image: DataFrame | Callable[[tuple[int, int], tuple[int, int]], DataFrame], states: DataFrame, grid: RadarGrid, values: list[str], body: Ellipsoid = WGS84, tile: int = 256) -> DataFrame:
    """Map cells (lon, lat, height, ...) with the bilinear values of a radar image (row, col, values).

    Cells are placed in the image and written; the lines and samples that they touch, one row, prune the image before it
    is cut into tiles; each cell joins the tile that it lies in. image may be a function of (first, after the last) rows and
    columns, such as a granule's reader, which then opens the chunks of that box only.
    Cells outside the image, without a height, or beside a missing value are null; complex images are geocoded by their
    parts. Nothing is broadcast but the orbit.
    """
    shape = (grid.rows, grid.cols)
    names = [c for c in cells.columns if c not in values and not c.startswith("g_")]
    place = dict(zip(("x", "y", "z"), to_xyz(F.col("lon"), F.col("lat"), F.col("height"), body), strict=True))
    shared_dir(cells.sparkSession)
    found = cut(inverse(cells.select(F.struct(*names).alias("g_row"), *[v.alias(c) for c, v in place.items()]), states, grid).select("g_row", "az", "rg"))
    inside = F.col("az").between(0, shape[0] - 1) & F.col("rg").between(0, shape[1] - 1)
    box = found.where(inside).agg(F.floor(F.min("az")), F.floor(F.max("az")), F.floor(F.min("rg")), F.floor(F.max("rg"))).first()
    if box[0] is None:
        return found.select("g_row.*", *[F.lit(None).cast("double").alias(v) for v in values])
    rows, cols = (int(box[0]), int(box[1]) + 2), (int(box[2]), int(box[3]) + 2)
    seen = image(rows, cols) if callable(image) else image
    seen = seen.where(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))
    tiles = tile_arrays(seen, shape, tile, 1, values).select(*[F.col(c).alias(f"m_{c}") for c in ("ty", "tx", "r0", "c0", "w", *values)])
    on = (F.floor(F.col("az") / tile) == F.col("m_ty")) & (F.floor(F.col("rg") / tile) == F.col("m_tx"))
    out = found.join(tiles, on & inside, "left")
    return out.select("g_row.*", *[at_place(F.col(f"m_{v}"), F.col("az"), F.col("rg"), shape, "m_").alias(v) for v in values])
