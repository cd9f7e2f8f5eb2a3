"""Queries of sources, sinks, array kernels and whole routes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import fixpoint as P
from tessera.operators import kernels as K
from tessera.operators.harmonic import harmonic_fill
from tessera.session import shared_dir
from tessera.sources import io as IO

from . import fixtures as X
from . import routes as Z
from .registry import query, r6, rounded


def _raster(s, d):
    return X.lattice(s, d).select(F.lit("az").alias("grid_id"), "row", "col", F.col("azimuth").alias("v"))


def _path(s, name):
    return f"{shared_dir(s)}/tessera/{name}-{uuid.uuid4().hex}"


@query("s02_window_scan", f"WITH {X.LAT} SELECT i, j, {r6('azimuth')} FROM lat WHERE i >= 10 AND i < 30 AND j >= 5 AND j < 25")
def s02(s, d):
    path = _path(s, "raster")
    IO.write_raster(_raster(s, d), path)
    return rounded(IO.read_raster(s, path, (10, 30), (5, 25)).select("row", "col", F.col("v").alias("azimuth")))


@query("s06_files_by_date", "WITH n AS (SELECT 'cache/' || (o_orderkey % 7) || '_' || strftime(o_orderdate, '%Y%m%d') || '.h5' AS path, strftime(o_orderdate, '%Y%m%d') AS d FROM orders) SELECT d, min(path) AS path FROM n WHERE d IN (SELECT DISTINCT d FROM n WHERE d LIKE '1996%') GROUP BY d")
def s06(s, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    n = X.table(s, d, "orders").select(F.concat(F.lit("cache/"), F.col("o_orderkey") % 7, F.lit("_"), day, F.lit(".h5")).alias("path"), day.alias("d"))
    return IO.files_by_date(n.select("path"), n.where("d like '1996%'").select("d"))


@query("s05_radar_fallback", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 1.0::DOUBLE * n_nationkey END, CASE WHEN n_nationkey % 3 = 1 THEN 2.0::DOUBLE * n_nationkey END, 1262.98::DOUBLE) AS azbw FROM nation")
def s05(s, d):
    k = F.col("n_nationkey")
    return X.table(s, d, "nation").select("n_nationkey", IO.fallback([F.when(k % 3 == 0, 1.0 * k), F.when(k % 3 == 1, 2.0 * k)], 1262.98).alias("azbw"))


@query("s07_nearest_layer", "WITH l AS (SELECT p_brand, p_size * 40.0::DOUBLE AS h, p_retailprice AS v, p_partkey FROM part) SELECT p_brand, h, p_partkey FROM l QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(h - 500), p_partkey) = 1")
def s07(s, d):
    p = X.table(s, d, "part").select("p_brand", (F.col("p_size") * 40.0).alias("h"), "p_partkey")
    return p.groupBy("p_brand").agg(F.min_by(F.struct("h", "p_partkey"), F.struct(F.abs(F.col("h") - 500), F.col("p_partkey"))).alias("b")).select("p_brand", "b.h", "b.p_partkey")


@query("s13_quicklook", f"WITH {X.LAT} SELECT i // 8 AS i, j // 8 AS j, round(avg(azimuth), 6) + 0.0::DOUBLE AS v FROM lat GROUP BY 1, 2")
def s13(s, d):
    return rounded(IO.decimated(_raster(s, d), 12, *X.LAT_SHAPE, cyclic=False).drop("grid_id"))


@query("s15_look_centres", f"WITH {X.LAT} SELECT i // 8 AS i, j // 4 AS j, round(azimuth, 6) + 0.0::DOUBLE AS v FROM lat WHERE i % 8 = 4 AND j % 4 = 2")
def s15(s, d):
    return rounded(IO.look_centres(_raster(s, d), 8, 4).drop("grid_id"))


@query("s20_cover_tiles", "WITH b AS (SELECT c_custkey, -150.0::DOUBLE + (c_custkey % 100) / 10.0 AS x, 58.0::DOUBLE + (c_custkey % 50) / 10.0 AS y FROM customer), t AS (SELECT c_custkey, unnest(range(CAST(floor(y / 3) * 3 AS INT), CAST(floor((y + 2) / 3) * 3 AS INT) + 1, 3)) AS la, x FROM b), u AS (SELECT c_custkey, la, unnest(range(CAST(floor(x / 3) * 3 AS INT), CAST(floor((x + 4) / 3) * 3 AS INT) + 1, 3)) AS lo FROM t) SELECT c_custkey, CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(la) AS VARCHAR), 2, '0') || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lo) AS VARCHAR), 3, '0') AS tile FROM u")
def s20(s, d):
    k = F.col("c_custkey")
    x, y = F.lit(-150.0) + (k % 100) / 10.0, F.lit(58.0) + (k % 50) / 10.0
    return X.table(s, d, "customer").select("c_custkey", F.explode(IO.cover_tiles(x, y, x + 4, y + 2)).alias("tile"))


@query("s23_wkt_points", "SELECT n_nationkey, k, CASE k WHEN 0 THEN n_nationkey WHEN 1 THEN n_nationkey + 2 ELSE n_nationkey + 1 END::DOUBLE AS x, CASE k WHEN 2 THEN n_regionkey + 3 ELSE n_regionkey END::DOUBLE AS y FROM nation, (SELECT unnest(range(0, 3)) AS k)")
def s23(s, d):
    a, b = F.col("n_nationkey"), F.col("n_regionkey")
    wkt = F.format_string("POLYGON ((%s %s 7, %s %s 7,%s %s))", a, b, a + 2, b, a + 1, b + 3)
    p = X.table(s, d, "nation").select("n_nationkey", F.posexplode(IO.wkt_points(wkt)).alias("k", "p"))
    return p.select("n_nationkey", F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query("k05_add_where_data", f"WITH {X.LAT} SELECT i, j, round(CASE WHEN (i + j) % 11 = 0 THEN -200000.0::DOUBLE ELSE azimuth + CASE WHEN snr >= 8 THEN range_ ELSE 0 END END, 6) + 0.0::DOUBLE AS v FROM lat")
def k05(s, d):
    lat = X.lattice(s, d)
    r = lat.select("row", "col", F.when((F.col("row") + F.col("col")) % 11 == 0, -200000.0).otherwise(F.col("azimuth")).alias("v"))
    return rounded(IO.add_in_place(r, lat.where("snr >= 8").select("row", "col", F.col("range").alias("d"))))


@query("k09_snapped_grid", f"WITH {X.POINTS}, b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM pt) SELECT floor((a - 0.5) / 0.25) * 0.25::DOUBLE AS x0, ceil((d + 0.5) / 0.25) * 0.25::DOUBLE AS y0, CAST(round((ceil((b + 0.5) / 0.25) - floor((a - 0.5) / 0.25))) AS INT) AS nx, CAST(round(ceil((d + 0.5) / 0.25) - floor((c - 0.5) / 0.25)) AS INT) AS ny FROM b")
def k09(s, d):
    return IO.snapped_grid(X.points(s, d), 0.25, 0.25, 0.5)


@query("k11_masked_copy", f"WITH {X.LAT} SELECT i, j, round(CASE WHEN snr >= 7 THEN azimuth END, 6) + 0.0::DOUBLE AS v FROM lat")
def k11(s, d):
    return rounded(IO.masked(_raster(s, d), X.lattice(s, d).where("snr < 7")).drop("grid_id"))


@query("k15_timing_shares", "SELECT event_type AS stage, round(sum(value), 2) AS seconds, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def k15(s, d):
    t = X.table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("seconds"))
    total = t.agg(F.sum("seconds").alias("t"))
    return t.crossJoin(F.broadcast(total)).select("stage", F.round("seconds", 2).alias("seconds"), F.round(F.col("seconds") / F.col("t"), 6).alias("share"))


@query("d01_tiles_round_trip", f"WITH {X.LAT} SELECT i, j, round(azimuth, 6) + 0.0::DOUBLE AS v FROM lat")
def d01(s, d):
    return rounded(IO.untiled(IO.tiles(_raster(s, d), 16), 16).drop("grid_id"))


@query("f32_setting_differences", "SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS have, p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS want FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0")
def f32(s, d):
    k = F.col("p_partkey")
    p = X.table(s, d, "part").select(F.concat(F.lit("k"), k).alias("key"), F.col("p_retailprice").alias("value"), k.alias("k"))
    return IO.setting_differences(p.where("k % 4 <> 0").select("key", "value"), p.select("key", (F.col("value") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("value")))


@query("m01_directionality")
def m01(s, d):
    coh = B.coherence(B.accumulate(X.stack(s, d), 1, 1))
    return rounded(Z.streak_index(coh, least=64, min_coh=1e-5).drop("coh_mean"), 4)


def _gaps(s, d):
    return X.lattice(s, d).select(F.lit("az").alias("grid_id"), "row", "col", F.when(F.col("snr") >= 7, F.col("azimuth")).alias("v"))


def _kernel(name, kernel):
    @query(name)
    def run(s, d):
        return rounded(K.apply_grids(_gaps(s, d), kernel).drop("grid_id"), 4)

    return run


for _n, _f in {
    "m02_rotation": lambda g: K.rotated(g, 20.0),
    "m05_tikhonov_integral": lambda g: K.integrate_rows(K.nearest_fill(g), 40.0),
    "m06_pls_fill": lambda g: K.fill(g, "pls", s=5.0),
    "m07_multigrid_fill": lambda g: K.fill(g, "pls_mg", s=5.0),
    "m08_oriented_fill": lambda g: K.oriented_fill(g, 5.0, 4.0, 20.0),
    "m10_biharmonic_fill": lambda g: K.fill(g, "biharmonic"),
    "m11_idw_fill": lambda g: K.fill(g, "idw_smooth"),
    "m13_polynomial_fill": lambda g: K.fill(g, "poly"),
    "m14_rbf_fill": lambda g: K.fill(g, "rbf"),
    "m15_griddata_fill": lambda g: K.fill(g, "griddata"),
    "m17_gradient_integration": lambda g: K.poisson(*(lambda v: (v[1:] - v[:-1], v[:, 1:] - v[:, :-1], v[1:] * 0 + 1, v[:, 1:] * 0 + 1))(K.nearest_fill(g))),
    "m18_unwrap": lambda g: K.unwrap(K.np.angle(K.np.exp(1j * K.nearest_fill(g)))),
    "r04_gap_fill": lambda g: K.local_fill(g),
    "w04_flat_lowpass": lambda g: K.lowpass_flat(g, (2.0, 2.0)),
}.items():
    _kernel(_n, _f)


@query("m09_laplace_fill")
def m09_laplace(s, d):
    return rounded(harmonic_fill(_gaps(s, d).drop("grid_id"), X.LAT_SHAPE, 24, 8), 4)


@query("m12_nearest_fill", f"WITH {X.LAT}, h AS (SELECT i, j, CASE WHEN snr >= 7 THEN azimuth END AS v FROM lat) SELECT a.i, a.j, round(arg_min(b.v, ((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) * 1000000::BIGINT + b.i * 1000 + b.j), 4) + 0.0::DOUBLE AS v FROM h a, h b WHERE b.v IS NOT NULL GROUP BY a.i, a.j")
def m12_nearest(s, d):
    found = P.nearest(_gaps(s, d).drop("grid_id"))
    return rounded(found.select("row", "col", F.coalesce("v", "near_v").alias("v")), 4)


def _clean(s, d):
    return Z.clean_lattice(X.lattice(s, d), (64.0, 64.0), 6.0)


@query("r16_clean_lattice")
def r16(s, d):
    return _clean(s, d).select(F.col("row").alias("i"), F.col("col").alias("j"), "keep")


@query("r09_fill_holes")
def r09(s, d):
    return rounded(Z.fill_channels(_clean(s, d)).select("row", "col", "azimuth", "range", "filled"), 4)


_META = {"az_spacing": 4.44, "wavelength": 0.242, "slant0": 800e3, "dslant": 120.0, "da": 71.0, "dr": 120.0, "kappa": 0.55}


@query("f11_offsets_screen")
def f11(s, d):
    return rounded(Z.offsets_screen(Z.fill_channels(_clean(s, d)), X.LAT_SHAPE, _META), 4)


@query("r15_split_screen")
def r15(s, d):
    return rounded(Z.split_screen(X.bands(s, d), X.FA, X.FB, X.LAT_SHAPE), 3)


@query("c07_hybrid_screen")
def c07(s, d):
    return rounded(Z.hybrid_screen(Z.split_screen(X.bands(s, d), X.FA, X.FB, X.LAT_SHAPE), Z.offsets_screen(Z.fill_channels(_clean(s, d)), X.LAT_SHAPE, _META), X.LAT_SHAPE, 0.5, 71.0), 3)


@query("m20_window_matching")
def m20(s, d):
    p = X.slc_pair(s, d)
    amp = lambda c: p.select("row", "col", F.sqrt(F.col(f"{c}_re") ** 2 + F.col(f"{c}_im") ** 2).alias("v"))
    return rounded(Z.match_windows(amp("r"), amp("s"), 16, 4, 16, X.PAIR_SHAPE), 4)
