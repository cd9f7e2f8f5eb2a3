"""Queries of GeoTIFF files, resampling, cube directions and the geometry of the integral."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import geometry as G
from tessera.sources import geotiff as T
from tessera.sources.grids import Grid, resampled, write_lattice_map

from . import fixtures as X
from .q_routes import _path
from .registry import query, r6, rounded

#: A map grid on which the lattice lies, and points that reach beyond it.
SRC = Grid(1000.0, 500.0, 2.0, X.LAT_SHAPE[1], X.LAT_SHAPE[0], 3413)
_POINTS = "p AS (SELECT CAST(id // 80 AS INT) AS i, CAST(id % 80 AS INT) AS j, 998.3::DOUBLE + 1.7::DOUBLE * (id % 80) AS x, 501.1::DOUBLE - 1.9::DOUBLE * (id // 80) AS y FROM (SELECT unnest(range(0, 8000)) AS id))"


def _points(s):
    p = s.range(8000).select(F.expr("cast(id div 80 as int)").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    return p.withColumns({"x": 998.3 + 1.7 * F.col("col"), "y": 501.1 - 1.9 * F.col("row")})


def _corners(values: str, nodes: str) -> str:
    """SQL: weighted corners of t (i, j, a, b), positions on the axes of a table of nodes (i, j, values)."""
    four = " UNION ALL ".join(f"SELECT i, j, la + {r} AS ri, lb + {c} AS rj, ({'a - la' if r else '1 - (a - la)'}) * ({'b - lb' if c else '1 - (b - lb)'}) AS w FROM lo" for r in (0, 1) for c in (0, 1))
    return f"cn AS ({four}), got AS (SELECT cn.i, cn.j, w, {values} FROM cn LEFT JOIN {nodes} n ON n.i = ri AND n.j = rj WHERE w <> 0)"


def _lattice_file(s, d, nodata=None, block=16):
    """The lattice as a mosaic of files of 32 x 32 cells."""
    path = f"{_path(s, 'geotiff')}.vrt"
    T.write_mosaic(X.kept(s, d), path, X.LAT_SHAPE, SRC.transform(), SRC.epsg, nodata, block=block, part=32)
    return path


@query("k01_geotiff", f"WITH {X.KEPT}, c AS (SELECT CAST(unnest(range(0, 96)) AS INT) AS i), e AS (SELECT i, CAST(unnest(range(0, 64)) AS INT) AS j FROM c) SELECT e.i, e.j, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) + 0.0::DOUBLE AS v FROM e LEFT JOIN k ON k.i = e.i AND k.j = e.j")
def k01(s, d):
    return rounded(T.read_geotiff(s, _lattice_file(s, d, -9999.0)).drop("grid_id"))


@query("s11_block_raster", f"WITH {X.KEPT}, c AS (SELECT CAST(unnest(range(76, 96)) AS INT) AS i), e AS (SELECT i, CAST(unnest(range(5, 40)) AS INT) AS j FROM c) SELECT e.i, e.j, coalesce(round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6), 0) + 0.0::DOUBLE AS v FROM e LEFT JOIN k ON k.i = e.i AND k.j = e.j")
def s11(s, d):
    return rounded(T.open_raster(s, _lattice_file(s, d), X.LAT_SHAPE, "float32", slice(-20, None), (5, 40)).drop("grid_id"))


@query("j14_resample_bilinear", f"WITH {X.LAT}, {_POINTS}, t AS (SELECT i, j, greatest(0, least(95, (499 - y) / 2)) AS a, greatest(0, least(63, (x - 1001) / 2)) AS b FROM p WHERE x >= 1000 AND x < 1128 AND y <= 500 AND y > 308), lo AS (SELECT *, greatest(0, least(floor(a), 94)) AS la, greatest(0, least(floor(b), 62)) AS lb FROM t), {_corners('azimuth AS v', 'lat')}, m AS (SELECT i, j, sum(w * v) AS s, sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) AS k FROM got GROUP BY i, j) SELECT p.i, p.j, CASE WHEN k > 0.99 THEN round(s / k, 6) + 0.0::DOUBLE END AS v FROM p LEFT JOIN m ON m.i = p.i AND m.j = p.j")
def j14(s, d):
    return rounded(resampled(_points(s), X.lattice(s, d).withColumnRenamed("azimuth", "v"), SRC))


@query("j15_warp_nearest", f"WITH {X.LAT}, {_POINTS} SELECT p.i, p.j, round(azimuth, 6) + 0.0::DOUBLE AS v FROM p LEFT JOIN lat ON lat.i = floor((500 - y) / 2) AND lat.j = floor((x - 1000) / 2)")
def j15(s, d):
    return rounded(resampled(_points(s), X.lattice(s, d).withColumnRenamed("azimuth", "v"), SRC, 0))


_CUBE = "cu AS (SELECT CAST(n_nationkey // 5 AS INT) AS i, CAST(n_nationkey % 5 AS INT) AS j, n_nationkey * n_nationkey % 7 * 1.0::DOUBLE AS az, n_nationkey * 3 % 11 + 0.5::DOUBLE AS rg, n_regionkey * 10.0::DOUBLE AS inc FROM nation)"
_AXES = "q AS (SELECT CAST(id // 14 AS INT) AS i, CAST(id % 14 AS INT) AS j FROM (SELECT unnest(range(0, 168)) AS id)), t AS (SELECT i, j, (0.41::DOUBLE * i - 0.3::DOUBLE) AS a, (0.53::DOUBLE * j - 0.7::DOUBLE) AS b FROM q), lo AS (SELECT *, greatest(0, least(floor(a), 3)) AS la, greatest(0, least(floor(b), 3)) AS lb FROM t)"


def _slope(v: str, axis: str) -> str:
    over = f"OVER (PARTITION BY {'j' if axis == 'i' else 'i'} ORDER BY {axis})"
    return f"coalesce((lead({v}) {over} - lag({v}) {over}) / 2, lead({v}) {over} - {v}, {v} - lag({v}) {over})"


@query("j18_cube_directions", f"WITH {_CUBE}, {_AXES}, {_corners('az, rg, inc', 'cu')}, v AS (SELECT i, j, sum(w * az) AS az, sum(w * rg) AS rg, sum(w * inc) AS inc FROM got GROUP BY i, j), g AS (SELECT *, {_slope('az', 'j')} / 30 AS ax, -({_slope('az', 'i')}) / 30 AS ay, {_slope('rg', 'j')} / 30 AS rx, -({_slope('rg', 'i')}) / 30 AS ry FROM v), u AS (SELECT *, CASE WHEN ax * ax + ay * ay > 0 THEN sqrt(ax * ax + ay * ay) ELSE 1 END AS an, CASE WHEN rx * rx + ry * ry > 0 THEN sqrt(rx * rx + ry * ry) ELSE 1 END AS rn FROM g) SELECT i, j, {r6('az', 'rg', 'inc')}, round(ax / an, 6) + 0.0::DOUBLE AS az_x, round(ay / an, 6) + 0.0::DOUBLE AS az_y, round(rx / rn, 6) + 0.0::DOUBLE AS rg_x, round(ry / rn, 6) + 0.0::DOUBLE AS rg_y FROM u")
def j18(s, d):
    k = F.col("n_nationkey")
    cube = X.table(s, d, "nation").select(F.expr("cast(n_nationkey div 5 as int)").alias("row"), (k % 5).cast("int").alias("col"), (k * k % 7 * 1.0).alias("az"), (k * 3 % 11 + 0.5).alias("rg"), (F.col("n_regionkey") * 10.0).alias("inc"))
    p = s.range(168).select(F.expr("cast(id div 14 as int)").alias("row"), (F.col("id") % 14).cast("int").alias("col"))
    p = p.withColumns({"x": 0.53 * F.col("col") - 0.7, "y": 0.41 * F.col("row") - 0.3})
    return rounded(G.cube_directions(p, cube, (0.0, 1.0, 5, 0.0, 1.0, 5), 30.0))


_META = {"first": 70, "skip": (32, 24), "slant0": 900_000.0, "dslant": 6.25, "az_spacing": 4.5, "speed": 7500.0, "prf": 1650.0, "wavelength": 0.2396, "shell_m": 350_000.0, "satellite": 7_118_000.0, "ground": 6_371_000.0}
_SLANT = "c AS (SELECT j, count(*) AS n FROM lat WHERE snr >= 8 GROUP BY j), r AS (SELECT j, n, 900000.0::DOUBLE + (70 + 24 * j) * 6.25::DOUBLE AS slant FROM c), e AS (SELECT *, slant * slant AS a, (7118000.0::DOUBLE * 7118000.0::DOUBLE + 6371000.0::DOUBLE * 6371000.0::DOUBLE - slant * slant) / 2 - 7118000.0::DOUBLE * 7118000.0::DOUBLE AS b, 7118000.0::DOUBLE * 7118000.0::DOUBLE - 6721000.0::DOUBLE * 6721000.0::DOUBLE AS k FROM r), f AS (SELECT *, 1 - (-b - sqrt(b * b - a * k)) / a AS kappa FROM e)"


@query("f08_integration_geometry", f"WITH {X.LAT}, {_SLANT} SELECT j, n, round(n * 144.0::DOUBLE / kappa, 4) AS length, {r6('slant', 'kappa')}, 144.0::DOUBLE AS da, 150.0::DOUBLE AS dr, round(144.0::DOUBLE / kappa, 6) AS ds, 0.2396::DOUBLE AS wavelength, round(32 * 7500.0::DOUBLE / 1650.0::DOUBLE, 6) AS ds_flat FROM f")
def f08(s, d):
    # columns of the lattice with their kept nodes, and the track that these stand for
    cols = X.lattice(s, d).where("snr >= 8").groupBy("col").agg(F.count("*").alias("n"))
    flat = G.integration_geometry(cols, {**_META, "shell_m": 0.0}).select("col", F.col("ds").alias("ds_flat"))
    out = G.integration_geometry(cols, _META).withColumn("length", F.col("n") * F.col("ds"))
    return rounded(out.join(flat, "col"), length=4)


@query("f28_delay_differences", "WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS freq, n_name AS d, CASE WHEN n_regionkey <> 2 OR n_nationkey % 5 <> 2 THEN 0.25::DOUBLE * (n_nationkey % 4) * (n_regionkey % 4) END AS delay, 20e6::DOUBLE * (1 + n_regionkey) AS bw FROM nation), r AS (SELECT freq, min_by(d, d) AS d0, min_by(bw, d) AS bw0, count(*) = count(delay) AS whole FROM n GROUP BY freq), z AS (SELECT n.*, r.bw0, n.delay - f.delay AS delta FROM n JOIN r ON r.freq = n.freq AND whole JOIN n f ON f.freq = r.freq AND f.d = r.d0) SELECT freq, d, round(delay, 6) AS delay, round(delta, 6) + 0.0::DOUBLE AS delta, round(abs(delta) / (299792458.0::DOUBLE / (2 * bw0)), 6) AS cells FROM z WHERE freq IN (SELECT freq FROM z GROUP BY freq HAVING max(abs(delta)) > 1e-6)")
def f28(s, d):
    r, k = F.col("n_regionkey"), F.col("n_nationkey")
    delay = F.when((r != 2) | (k % 5 != 2), 0.25 * (k % 4) * (r % 4))
    n = X.table(s, d, "nation").select(r.cast("string").alias("freq"), F.col("n_name").alias("d"), delay.alias("delay"), (20e6 * (1 + r)).alias("bandwidth"))
    out = G.delay_differences(n)
    return out.select("freq", "d", *[S.q(F.col(c)).alias(c) for c in ("delay", "delta", "cells")])


@query("p12_solve_domain", f"WITH {X.BANDS} SELECT i, j, snr >= 5 AND azimuth > -2.5 AND range_ < 0.7 AS valid FROM bd JOIN (SELECT i, j, snr FROM lat) USING (i, j)")
def p12(s, d):
    lat = X.lattice(s, d)
    phases = lat.select("row", "col", (F.col("snr") >= 5).alias("valid"), F.when(F.col("azimuth") > -2.5, F.col("azimuth")).alias("phi_a"), F.when(F.col("range") < 0.7, F.col("range")).otherwise(F.lit(float("nan"))).alias("phi_d"))
    return rounded(G.solve_domain(phases).select("row", "col", "valid"))


@query("k07_applied_state", f"WITH {X.LAT} SELECT i, j, CASE WHEN snr >= 8 THEN round(azimuth, 6) + 0.0::DOUBLE ELSE 0 END AS v, 0.0::DOUBLE AS other FROM lat")
def k07(s, d):
    lat, state = X.lattice(s, d), X.kept(s, d)
    other = G.state_or_zero(lat, state, (1, 1)).withColumnRenamed("v", "other")
    return rounded(G.state_or_zero(lat, state, X.LAT_SHAPE).join(other, ["row", "col"]))


#: A map grid finer than the lattice, so that most cells hold no node.
_MAP = Grid(995.0, 515.0, 1.0, 140, 150, 3413)
_CLOSE = ", ".join(f"({i}, {j})" for i in range(-4, 5) for j in range(-4, 5) if i * i + j * j <= 16)


def _closed(name: str, value: str) -> str:
    """SQL: mean of a column by map cell, then the nearest within four cells."""
    return f"{name}0 AS (SELECT a, b, avg({value}) AS v FROM nd WHERE {value} IS NOT NULL GROUP BY a, b), {name} AS (SELECT a + di AS i, b + dj AS j, arg_min(v, (di * di + dj * dj) * 1000000 + a * 1000 + b) AS v FROM {name}0, near WHERE a BETWEEN 0 AND 149 AND b BETWEEN 0 AND 139 AND a + di BETWEEN 0 AND 149 AND b + dj BETWEEN 0 AND 139 GROUP BY 1, 2)"


@query("k12_lattice_map", f"WITH {X.LAT}, near(di, dj) AS (VALUES {_CLOSE}), nd AS (SELECT azimuth AS v, CASE WHEN snr >= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok, CAST(trunc((500.3::DOUBLE - 1.37::DOUBLE * i + 0.21::DOUBLE * j - 515) / -1.0::DOUBLE) AS INT) AS a, CAST(trunc(1001.2::DOUBLE + 1.91::DOUBLE * j + 0.17::DOUBLE * i - 995) AS INT) AS b FROM lat), {_closed('vv', 'v')}, {_closed('va', 'ok')} SELECT vv.i, vv.j, round(CAST(CAST(vv.v AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS v, va.v > 0.5 AS valid FROM vv JOIN va ON va.i = vv.i AND va.j = vv.j")
def k12(s, d):
    row, col = F.col("row"), F.col("col")
    nodes = X.lattice(s, d).select((1001.2 + 1.91 * col + 0.17 * row).alias("x"), (500.3 - 1.37 * row + 0.21 * col).alias("y"), F.col("azimuth").alias("v"), F.when(F.col("snr") >= 8, 1.0).otherwise(0.0).alias("valid"))
    value, valid = write_lattice_map(nodes, _MAP, _path(s, "lattice-map"), block=16, part=64)
    both = T.read_geotiff(s, value).where("v is not null").join(T.read_geotiff(s, valid).select("row", "col", (F.col("v") > 0.5).alias("valid")), ["row", "col"])
    return rounded(both.drop("grid_id"), 5)
