"""Queries of granules, radar geometry, geocoding, resampling, patch filters and refocusing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import orbits as O
from tessera.operators import patches as P
from tessera.operators import refocusing as R
from tessera.operators import resample as M
from tessera.sources import granule as G

from . import fixtures as X
from .products import Options, interferogram
from .q_routes import _path
from .registry import query, rounded

#: A round body, and a straight orbit over it that SQL can follow; both are exact for cubic Hermite curves.
BODY = O.Ellipsoid(6371000.0, 6371000.0)
HEIGHT, SPEED = 7070000.0, 7500.0
RADAR = O.RadarGrid(0.0, 30.0, 820000.0, 400.0, "right", *X.PAIR_SHAPE)


def _states(s, d):
    """A state for each nation, two seconds apart."""
    k = F.col("n_nationkey")
    t = (2.0 * k - 10.0).cast("double")
    zero = F.lit(0.0)
    return X.table(s, d, "nation").select(t.alias("t"), F.lit(HEIGHT).alias("x"), zero.alias("y"), (SPEED * t).alias("z"), zero.alias("vx"), zero.alias("vy"), F.lit(SPEED).alias("vz"))


def _amplitude(s, d):
    return X.slc_pair(s, d).select("row", "col", F.sqrt(F.col("r_re") * F.col("r_re") + F.col("r_im") * F.col("r_im")).alias("v"))


@query("m21_forward_geometry", f"WITH {X.LAT}, p AS (SELECT i, j, 40 * azimuth AS h, 820000.0::DOUBLE + j * 400.0::DOUBLE AS r, 7500.0::DOUBLE * (i / 30.0::DOUBLE) AS z FROM lat), c AS (SELECT *, (7070000.0::DOUBLE * 7070000.0::DOUBLE + z * z + r * r - (6371000 + h) * (6371000 + h)) / (2 * r * 7070000.0::DOUBLE) AS co FROM p), g AS (SELECT i, j, h, z, 7070000.0::DOUBLE - r * co AS x, r * sqrt(1 - co * co) AS y FROM c) SELECT i, j, round(degrees(atan2(y, x)), 7) + 0.0::DOUBLE AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 7) + 0.0::DOUBLE AS lat, round(h, 2) + 0.0::DOUBLE AS height FROM g")
def m21(s, d):
    points = X.lattice(s, d).select("row", "col", (40 * F.col("azimuth")).alias("h"))
    return rounded(O.forward(points, _states(s, d), RADAR, "h", BODY).select("row", "col", "lon", "lat", "height"), 7, height=2)


#: Map cells over the image and beyond it, with heights from the lattice.
_MAP = "mp AS (SELECT i, j, 3.95::DOUBLE + 0.0061::DOUBLE * j AS lon, 0.55::DOUBLE - 0.0063::DOUBLE * i AS lat, 40 * azimuth AS h FROM lat)"


def _map_cells(s, d):
    return X.lattice(s, d).select("row", "col", (3.95 + 0.0061 * F.col("col")).alias("lon"), (0.55 - 0.0063 * F.col("row")).alias("lat"), (40 * F.col("azimuth")).alias("height"))


_SEEN = "xyz AS (SELECT *, (6371000 + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (6371000 + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (6371000 + h) * sin(radians(lat)) AS z FROM mp), se AS (SELECT i, j, z / 7500.0::DOUBLE * 30 AS az, (sqrt((x - 7070000.0::DOUBLE) * (x - 7070000.0::DOUBLE) + y * y) - 820000.0::DOUBLE) / 400 AS rg FROM xyz)"


@query("m21_inverse_geometry", f"WITH {X.LAT}, {_MAP}, {_SEEN} SELECT i, j, round(az, 4) + 0.0::DOUBLE AS az, round(rg, 4) + 0.0::DOUBLE AS rg FROM se")
def m21_inverse(s, d):
    cells = _map_cells(s, d)
    x, y, z = O.to_xyz(F.col("lon"), F.col("lat"), F.col("height"), BODY)
    return rounded(O.inverse(cells.select("row", "col", x.alias("x"), y.alias("y"), z.alias("z")), _states(s, d), RADAR).select("row", "col", "az", "rg"), 4)


@query("j20_geocoding", f"WITH {X.LAT}, {X.PAIR}, {_MAP}, {_SEEN}, lo AS (SELECT *, least(floor(az), 238) AS la, least(floor(rg), 126) AS lb FROM se WHERE az BETWEEN 0 AND 239 AND rg BETWEEN 0 AND 127), cn AS (" + " UNION ALL ".join(f"SELECT i, j, la + {a} AS ri, lb + {b} AS rj, ({'az - la' if a else '1 - (az - la)'}) * ({'rg - lb' if b else '1 - (rg - lb)'}) AS w FROM lo" for a in (0, 1) for b in (0, 1)) + "), got AS (SELECT cn.i, cn.j, sum(w * sqrt(r_re * r_re + r_im * r_im)) AS v, count(r_re) AS n FROM cn LEFT JOIN pr ON pr.i = ri AND pr.j = rj GROUP BY 1, 2) SELECT se.i, se.j, CASE WHEN n = 4 THEN round(v, 4) + 0.0::DOUBLE END AS v FROM se LEFT JOIN got USING (i, j)")
def j20(s, d):
    return rounded(O.geocoded(_map_cells(s, d), _amplitude(s, d), _states(s, d), RADAR, ["v"], BODY, tile=32).select("row", "col", "v"), 4)


def _granules(s, d):
    """A folder with one granule of the image pair: two frequencies, uneven axes, an orbit."""
    folder = _path(s, "granules")
    path = f"{folder}/pair"
    rows, cols = X.PAIR_SHAPE
    pair = X.slc_pair(s, d)
    group = "science/LSAR/RSLC/swaths"
    for freq, re, im in (("A", "r_re", "r_im"), ("B", "s_re", "s_im")):
        G.write_image(pair.select("row", "col", F.col(re).alias("re"), F.col(im).alias("im")), path, f"{group}/frequency{freq}/HH", X.PAIR_SHAPE, (64, 48))
    # axes of the fixture, one value a line or a sample
    quantity = X._cells(X.table(s, d, "lineitem"), rows, cols)
    line, sample = ({r[0]: r[1] for r in quantity.groupBy(c).agg(F.avg(v)).collect()} for c, v in (("row", "l_quantity"), ("col", "l_tax")))
    G.write_array(path, f"{group}/zeroDopplerTime", [k / 1500.0 + 1e-6 * round(line.get(k, 0.0), 6) for k in range(rows)])
    for freq, name, fc in (("A", "processedCenterFrequency", X.FA), ("B", "acquiredCenterFrequency", X.FB)):
        G.write_array(path, f"{group}/frequency{freq}/slantRange", [820000.0 + 3.75 * k + round(sample.get(k, 0.0), 6) for k in range(cols)])
        G.write_array(path, f"{group}/frequency{freq}/{name}", fc * 1e6)
    states = _states(s, d).orderBy("t").collect()
    for name, fields in (("time", ("t",)), ("position", ("x", "y", "z")), ("velocity", ("vx", "vy", "vz"))):
        values = [[r[f] for f in fields] for r in states]
        G.write_array(path, f"science/LSAR/RSLC/metadata/orbit/{name}", [v[0] for v in values] if name == "time" else values)
    G.close_granule(path)
    return folder


@query("s01_granule_samples", f"WITH {X.PAIR} SELECT 'pair' AS granule, i, j, round(CAST(CAST(s_re AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS re, round(CAST(CAST(s_im AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS im FROM pr WHERE i >= 70 AND i < 190 AND j > 20")
def s01(s, d):
    samples = G.load_slc(s, _granules(s, d), "B", rows=(70, 190), cols=(21, X.PAIR_SHAPE[1]))["samples"]
    return rounded(samples.where("re <> 0 or im <> 0").withColumns({c: F.col(c).cast("double") for c in ("re", "im")}), 5)


@query("s03_swath_axes", "WITH a AS (SELECT 'azimuth' AS axis, CAST(l_orderkey % 240 AS INT) AS i, round(CAST(l_orderkey % 240 AS INT) / 1500.0::DOUBLE + 1e-6::DOUBLE * round(avg(l_quantity), 6), 9) AS v FROM lineitem GROUP BY 1, 2, l_orderkey % 240), r AS (SELECT 'range' AS axis, CAST(l_partkey % 128 AS INT) AS i, round(820000.0::DOUBLE + 3.75::DOUBLE * CAST(l_partkey % 128 AS INT) + round(avg(l_tax), 6), 6) AS v FROM lineitem GROUP BY 1, 2, l_partkey % 128) SELECT *, 1293500000.0::DOUBLE AS fc FROM (SELECT * FROM a UNION ALL SELECT * FROM r)")
def s03(s, d):
    found = G.swath_axes(s, _granules(s, d), "B")
    # one row
    axes = found["axes"].crossJoin(F.broadcast(found["radar"].select("fc")))
    return axes.select("axis", "i", F.when(F.col("axis") == "azimuth", F.round("v", 9)).otherwise(F.round("v", 6)).alias("v"), "fc")


@query("s04_map_grids", f"WITH {X.STACK}, y AS (SELECT d, min(i) AS i0, min(j) AS j0, count(*) AS n FROM st GROUP BY d) SELECT d AS granule, f AS frequency, 48 AS rows, 48 AS cols, CAST(1000 + 30 * j0 AS DOUBLE) AS x0, 30.0::DOUBLE AS dx, CAST(5000 - 30 * i0 AS DOUBLE) AS y0, -30.0::DOUBLE AS dy, CASE f WHEN 'A' THEN 1239000000.0::DOUBLE ELSE 1293500000.0::DOUBLE END AS fc, CASE f WHEN 'A' THEN 40000000.0::DOUBLE END AS bw, 3413 AS epsg, CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) END AS delay FROM y, (VALUES ('A'), ('B')) t(f)")
def s04(s, d):
    folder = _path(s, "map-granules")
    stack = X.stack(s, d)
    # one row a year
    for r in stack.groupBy("d").agg(F.min("row").alias("i0"), F.min("col").alias("j0"), F.count("*").alias("n")).collect():
        path = f"{folder}/{r.d}"
        product = "science/LSAR/GSLC"
        for freq, fc in (("A", X.FA), ("B", X.FB)):
            group = f"{product}/grids/frequency{freq}"
            G.write_image(stack.where(F.col("d") == r.d), path, f"{group}/HH", X.STACK_SHAPE, (32, 32))
            G.write_array(path, f"{group}/xCoordinates", [1000.0 + 30 * (r.j0 + k) for k in range(X.STACK_SHAPE[1])])
            G.write_array(path, f"{group}/yCoordinates", [5000.0 - 30 * (r.i0 + k) for k in range(X.STACK_SHAPE[0])])
            for name, value in (("xCoordinateSpacing", 30.0), ("yCoordinateSpacing", -30.0), ("centerFrequency", fc * 1e6), ("projection", 3413)):
                G.write_array(path, f"{group}/{name}", value)
            if freq == "A":
                G.write_array(path, f"{group}/rangeBandwidth", 4e7)
            if r.n % 2 == 0:
                G.write_array(path, f"{product}/metadata/calibrationInformation/frequency{freq}/commonDelay", float(r.n))
        G.close_granule(path)
    return G.grid_of(s, folder).drop("azbw")


#: A lattice of offsets over the image pair, with gross offsets besides.
NODES = M.Lattice((8.0, 6.0), (16.0, 16.0), (15, 8))


def _offsets(s, d):
    return X.lattice(s, d).where(f"row < {NODES.shape[0]} and col < {NODES.shape[1]}").select("row", "col", (0.3 * F.col("azimuth") + 5.0).alias("az"), (0.2 * F.col("range") - 3.0).alias("rg"))


def _image(s, d, side):
    return X.slc_pair(s, d).select("row", "col", F.col(f"{side}_re").alias("re"), F.col(f"{side}_im").alias("im"))


_TAP = "CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END * cos(pi() * x / 8) * cos(pi() * x / 8)"


@query("m22_resampling", f"WITH {X.LAT}, {X.PAIR}, nd AS (SELECT i, j, 0.3::DOUBLE * azimuth + 5 AS az, 0.2::DOUBLE * range_ - 3 AS rg FROM lat WHERE i < 15 AND j < 8), e AS (SELECT CAST(unnest(range(0, 240)) AS INT) AS i), o AS (SELECT i, CAST(unnest(range(0, 128)) AS INT) AS j FROM e), t AS (SELECT i, j, least(greatest((i - 8) / 16.0::DOUBLE, 0), 14) AS a, least(greatest((j - 6) / 16.0::DOUBLE, 0), 7) AS b FROM o), lo AS (SELECT *, least(floor(a), 13) AS la, least(floor(b), 6) AS lb FROM t), cn AS (" + " UNION ALL ".join(f"SELECT i, j, la + {a} AS ri, lb + {b} AS rj, ({'a - la' if a else '1 - (a - la)'}) * ({'b - lb' if b else '1 - (b - lb)'}) AS w FROM lo" for a in (0, 1) for b in (0, 1)) + f"), fd AS (SELECT cn.i, cn.j, cn.i + sum(w * coalesce(az, 0)) AS y, cn.j + sum(w * coalesce(rg, 0)) AS x FROM cn LEFT JOIN nd ON nd.i = ri AND nd.j = rj GROUP BY 1, 2), k AS (SELECT CAST(unnest(range(-3, 5)) AS INT) AS k), ty AS (SELECT i, j, CAST(floor(y) AS INT) + k AS p, y - floor(y) - k AS x FROM fd, k), tx AS (SELECT i, j, CAST(floor(x) AS INT) + k AS q, x - floor(x) - k AS x FROM fd, k), wy AS (SELECT i, j, p, {_TAP} AS w FROM ty), wx AS (SELECT i, j, q, {_TAP} AS w FROM tx), ny AS (SELECT i, j, p, w / sum(w) OVER (PARTITION BY i, j) AS w FROM wy), nx AS (SELECT i, j, q, w / sum(w) OVER (PARTITION BY i, j) AS w FROM wx) SELECT ny.i, ny.j, round(sum(ny.w * nx.w * coalesce(s_re, 0)), 4) + 0.0::DOUBLE AS re, round(sum(ny.w * nx.w * coalesce(s_im, 0)), 4) + 0.0::DOUBLE AS im FROM ny JOIN nx ON nx.i = ny.i AND nx.j = ny.j LEFT JOIN pr ON pr.i = p AND pr.j = q GROUP BY 1, 2 HAVING min(p) >= 0 AND max(p) < 240 AND min(q) >= 0 AND max(q) < 128")
def m22(s, d):
    return rounded(M.resampled_image(_image(s, d, "s"), _offsets(s, d), NODES, X.PAIR_SHAPE, tile=64), 4)


@query("w15_patch_filter")
def w15(s, d):
    return rounded(P.patch_filtered(_product(s, d), X.PAIR_SHAPE, tile=64))


def _product(s, d):
    p = X.slc_pair(s, d)
    re, im = F.col("r_re") * F.col("s_re") + F.col("r_im") * F.col("s_im"), F.col("r_im") * F.col("s_re") - F.col("r_re") * F.col("s_im")
    return p.select("row", "col", re.alias("re"), im.alias("im"))


#: Lines a second, bandwidth, centre and spacing of the pair, and the steering field's lattice.
BAND = R.Band(1520.0, 1262.5, -557.0, 4.44)
STEER = M.Lattice((4.0, 4.0), (4.0, 4.0), (58, 31))


def _steering(s, d):
    return X.lattice(s, d).where(f"row < {STEER.shape[0]} and col < {STEER.shape[1]}").select("row", "col", F.col("azimuth").alias("v"))


def _flat_pair(s, d):
    names = {f"{a}_{b}": f"{c}_{b}" for a, c in (("r", "a"), ("s", "b")) for b in ("re", "im")}
    return X.slc_pair(s, d).withColumnsRenamed(names)


@query("m19_refocus")
def m19(s, d):
    image, _ = R.refocus(_flat_pair(s, d), _steering(s, d), STEER, X.PAIR_SHAPE, BAND, 0.2, 48, 24, 32, least_spread=0.5, looks=(8, 8))
    return rounded(image)


@query("c08_refocus_sweep")
def c08(s, d):
    sweep = R.calibrated(_flat_pair(s, d), _steering(s, d), STEER, X.PAIR_SHAPE, BAND, 48, 32, 6, (0.0, 0.1, 0.2, 0.4), (8, 8))
    return sweep.select("along_km", F.round("coherence", 6).alias("coherence"), "better", "n")


@query("c08_local_gains")
def c08_gains(s, d):
    gains = R.local_gains(_flat_pair(s, d), _steering(s, d), STEER, X.PAIR_SHAPE, BAND, 0.2, 48, 32, 0.5, looks=(8, 8))
    return gains.select("gi", "gj", "gain", F.transform("coherences", lambda c: F.round(c, 6)).alias("coherences"))


def _focused(s, path, image, late):
    """A focused granule of a part of the pair, seen from the straight orbit some lines late."""
    grid = RADAR
    G.write_image(image, path, "slc", X.PAIR_SHAPE, (64, 64))
    G.write_attributes(path, "radargrid", {"sensing_start": grid.sensing_start - late / grid.prf, "wavelength": 0.25, "prf": grid.prf, "starting_range": grid.starting_range, "range_pixel_spacing": grid.range_spacing, "lookside": grid.lookside, "length": grid.rows, "width": grid.cols, "ref_epoch": ""})


@query("c10_interferogram")
def c10(s, d):
    folder = _path(s, "interferogram")
    states = _states(s, d).orderBy("t").collect()
    for name, side, late in (("ref", "r", 0.0), ("sec", "s", 2.25)):
        path = f"{folder}/{name}"
        _focused(s, path, _image(s, d, side), late)
        for key, fields in (("time", ("t",)), ("position", ("x", "y", "z")), ("velocity", ("vx", "vy", "vz"))):
            values = [[r[f] for f in fields] for r in states]
            G.write_array(path, f"orbit/{key}", [v[0] for v in values] if key == "time" else values)
        G.close_granule(path)
    made, _ = interferogram(s, f"{folder}/ref", f"{folder}/sec", f"{folder}/out", Options(skip=(32, 32), looks=(4, 4), nfft=8, tile=64))
    filtered = made["filtered"].select("row", "col", F.col("re").alias("f_re"), F.col("im").alias("f_im"))
    return rounded(made["looks"].join(filtered, ["row", "col"], "left"), 4)
