"""Granules, radar geometry, geocoding, resampling, patch filters and refocusing."""

import json
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import orbits as O
from tessera.operators import patches as P
from tessera.operators import refocusing as R
from tessera.operators import resample as M
from tessera.operators import tiling as T
from tessera.sources import granule as G

SF = "/root/testdata/sf0.01"
NAMES = ["s01_granule_samples", "s03_swath_axes", "s04_map_grids", "m21_forward_geometry", "m21_inverse_geometry", "j20_geocoding", "m22_resampling"]


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(round(r[k], 9) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, rel = plans.QUERIES[name](spark, SF), con.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = df.collect()
    assert len(rows) > 10 and rows_of(rows, df.columns) == rows_of(rel.fetchall(), rel.columns)


def cells(spark, a, **names):
    """A complex or real array as (row, col, re, im) or (row, col, v)."""
    r, c = np.indices(a.shape)
    own = {"re": a.real.ravel(), "im": a.imag.ravel()} if np.iscomplexobj(a) else {"v": a.ravel()}
    pdf = pd.DataFrame({"row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), **own})
    return spark.createDataFrame(pdf).withColumnsRenamed(names)


def dense(df, shape, *values):
    pdf = df.toPandas()
    out = [np.full(shape, np.nan) for _ in values]
    for a, v in zip(out, values, strict=True):
        a[pdf["row"], pdf["col"]] = pdf[v].to_numpy(float, na_value=np.nan)
    return out


# ---- granules --------------------------------------------------------------------------------------------------------
def focused(spark, path, a, half=False, chunks=(16, 24)):
    G.write_image(cells(spark, a), path, "slc", a.shape, chunks, half)
    G.write_attributes(path, "radargrid", {"sensing_start": 5.0, "wavelength": 0.24, "prf": 1500.0, "starting_range": 9e5, "range_pixel_spacing": 4.0, "lookside": "Right", "length": a.shape[0], "width": a.shape[1], "ref_epoch": "2025-01-01T00:00:00"})


def test_focused_granules(spark, tmp_path):
    a = (np.arange(50 * 70).reshape(50, 70) % 97 + 1j * (np.arange(50 * 70).reshape(50, 70) % 31)).astype(complex)
    for name, half in (("g1", True), ("g2", False)):
        focused(spark, f"{tmp_path}/{name}", a, half)
        G.write_array(f"{tmp_path}/{name}", "orbit/time", [0.0, 1.0, 2.0])
        G.write_array(f"{tmp_path}/{name}", "orbit/position", [[0.0, 0.0, k * 7.0] for k in range(3)])
        for key, v in (("y", [0.0, 1.0]), ("x", [1.0, 2.0, 3.0]), ("data", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])):
            G.write_array(f"{tmp_path}/{name}", f"dop/{key}", v)
        G.close_granule(f"{tmp_path}/{name}")
    focused(spark, f"{tmp_path}/open", a)
    both = G.read_granules(spark, str(tmp_path))
    assert {r.granule for r in both.select("granule").distinct().collect()} == {"g1", "g2"}
    for name in ("g1", "g2"):
        re, im = dense(both.where(F.col("granule") == name), a.shape, "re", "im")
        assert np.array_equal(re + 1j * im, a)
    one = G.load_slc(spark, f"{tmp_path}/g1")
    radar = one["radar"].first()
    assert (radar.rows, radar.cols, radar.lookside, radar.starting_range) == (50, 70, "right", 9e5) and abs(radar.wavelength - 0.24) < 1e-12
    assert one["orbit"].count() == 3 and one["orbit"].where("abs(vz - 7) < 1e-9").count() == 3
    assert [r.v for r in one["doppler"].orderBy("i", "j").collect()] == [1, 2, 3, 4, 5, 6]
    axes = G.swath_axes(spark, f"{tmp_path}/g2", "A")["axes"]
    assert axes.where("axis = 'range'").count() == 70 and axes.where("axis = 'azimuth' and i = 3").first().v == 5.0 + 3 / 1500
    assert G.same_azimuth(axes, axes.withColumn("v", F.col("v") + 0)).first().same


def test_only_chunks_of_the_window_are_opened(spark, tmp_path):
    a = np.arange(64.0 * 96).reshape(64, 96) + 0j
    path = f"{tmp_path}/g"
    focused(spark, path, a)
    G.close_granule(path)
    whole = G.read_granules(spark, path)
    # a filter of one query leaves the next alone
    assert [whole.where("row < 20").count(), whole.count(), whole.where("col = 3").count(), whole.count()] == [20 * 96, 64 * 96, 64, 64 * 96]
    for name in os.listdir(f"{path}/slc"):
        if name not in ("1.2", "2.2", ".zarray"):
            with open(f"{path}/slc/{name}", "wb") as f:
                f.write(b"broken")
    kept = G.load_slc(spark, path, rows=(16, 41), cols=(48, 72))["samples"]
    assert kept.agg(F.count("*"), F.sum("re")).first()[:] == (25 * 24, a[16:41, 48:72].real.sum())
    assert G.read_granules(spark, path, rows=(20, 21), cols=(50, 53), granules="g,h").count() == 3
    assert G.read_granules(spark, path, rows=(20, 20)).count() == 0 and G.read_granules(spark, path, granules="h").count() == 0
    with pytest.raises(Exception, match="(?i)incorrect header|invalid"):
        whole.count()


def test_products_and_what_they_lack(spark, tmp_path):
    path = f"{tmp_path}/p"
    swaths = "science/SSAR/RSLC/swaths"
    G.write_image(cells(spark, np.ones((8, 6), complex)), path, f"{swaths}/frequencyA/VV", (8, 6), (4, 4))
    G.write_array(path, f"{swaths}/zeroDopplerTime", np.arange(8) / 10)
    G.write_array(path, f"{swaths}/frequencyA/slantRange", 100.0 + np.arange(6))
    G.write_array(path, f"{swaths}/frequencyA/acquiredCenterFrequency", 1.2e9)
    G.close_granule(path)
    radar = G.read_granules(spark, path, "radar", polarization="VV").first()
    assert radar.fc == 1.2e9 and abs(radar.prf - 10) < 1e-9 and radar.range_spacing == 1
    assert G.read_granules(spark, path, "doppler").count() == 0
    for freq, pol, told in (("B", "VV", "no frequencyB, but frequencyA"), ("A", "HH", "no HH at frequencyA, but VV")):
        with pytest.raises(Exception, match=told):
            G.read_granules(spark, path, frequency=freq, polarization=pol).count()
    with pytest.raises(Exception, match="no map grids"):
        G.grid_of(spark, path).count()
    with pytest.raises(Exception, match="no table"):
        G.read_granules(spark, path, "pixels").count()
    with pytest.raises(Exception, match="outside"):
        G.write_image(cells(spark, np.ones((9, 6), complex)), path, "other", (8, 6))


def test_chunks_by_hand(spark, tmp_path):
    path = tmp_path / "z"
    (path / "slc").mkdir(parents=True)
    (path / "radargrid").mkdir()
    (path / "radargrid/.zattrs").write_text("{}")
    (path / ".zgroup").write_text('{"zarr_format": 2}')
    about = {"zarr_format": 2, "shape": [3, 5], "chunks": [2, 3], "dtype": [["r", "<f2"], ["i", "<f2"]], "compressor": {"id": "gzip", "level": 1}, "fill_value": None, "order": "F", "filters": None}
    (path / "slc/.zarray").write_text(json.dumps(about))
    a = np.zeros((2, 3), [("r", "<f2"), ("i", "<f2")])
    a["r"], a["i"] = [[1, 2, 3], [4, 5, 6]], 0.5
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    (path / "slc/0.0").write_bytes(pack.compress(a.tobytes(order="F")) + pack.flush())
    re, im = dense(G.read_granules(spark, str(path)), (3, 5), "re", "im")
    assert np.array_equal(re, [[1, 2, 3, 0, 0], [4, 5, 6, 0, 0], [0] * 5]) and im.sum() == 3


# ---- geometry --------------------------------------------------------------------------------------------------------
def circular(spark, n=30, step=5.0, higher=0.0, later=0.0):
    """States of a circular orbit, inclined by 98 degrees."""
    a, w = 7.08e6 + higher, np.sqrt(3.986004418e14 / 7.08e6**3)
    t = np.arange(n) * step + later
    inc = np.radians(98.0)
    u = w * t + 0.6
    p = a * np.stack([np.cos(u), np.sin(u) * np.cos(inc), np.sin(u) * np.sin(inc)], 1)
    v = a * w * np.stack([-np.sin(u), np.cos(u) * np.cos(inc), np.cos(u) * np.sin(inc)], 1)
    return spark.createDataFrame(pd.DataFrame(np.column_stack([t, p, v]), columns=list(O.STATE)))


def image_points(spark, n=40, m=30, step=50):
    return spark.range(n * m).select((F.expr(f"id div {m}") * step).cast("int").alias("row"), ((F.col("id") % m) * step).cast("int").alias("col"))


@pytest.mark.parametrize("side", ["left", "right"])
def test_there_and_back(spark, side):
    grid = O.RadarGrid(60.0, 1500.0, 850000.0, 6.0, side, 4000, 3000)
    states = circular(spark)
    points = image_points(spark).withColumn("h", (F.col("row") % 7) * 300.0).withColumn("lon", F.lit("old"))
    ground = O.forward(points, states, grid, "h")
    got = ground.toPandas()
    assert got["height"].notna().all() and np.abs(got["height"] - got["h"]).max() < 0.01
    x, y, z = (c.alias(n) for c, n in zip(O.to_xyz(F.col("lon"), F.col("lat"), F.col("height")), "xyz", strict=True))
    again = ground.select("x", "y", "z").toPandas().sort_values("x").to_numpy()
    assert np.abs(again - ground.select(x, y, z).toPandas().sort_values("x").to_numpy()).max() < 1e-3
    back = O.inverse(ground, states, grid).toPandas()
    assert np.abs(back["az"] - back["row"]).max() < 0.05 and np.abs(back["rg"] - back["col"]).max() < 0.05
    assert np.abs(back["az"] - back["row"]).max() < 1e-4
    # the two sides lie on either side of the track
    track = O.forward(image_points(spark, 1, 1), states, O.RadarGrid(60.0, 1500.0, 850000.0, 6.0, "right" if side == "left" else "left", 4000, 3000)).first()
    assert abs(track.lon - got["lon"].iloc[0]) > 2


def test_heights_move_a_point_as_computed_by_hand(spark):
    body = O.Ellipsoid(6371000.0, 6371000.0)
    states = spark.createDataFrame([(2.0 * k, 7070000.0, 0.0, 15000.0 * k, 0.0, 0.0, 7500.0) for k in range(5)], ", ".join(f"{c} double" for c in O.STATE))
    grid = O.RadarGrid(0.0, 100.0, 800000.0, 1.0, "right", 1, 1)
    point = image_points(spark, 1, 1)
    low, high = (O.forward(point, states, grid, h, body).first() for h in (0.0, 1000.0))
    cos = lambda h: (7070000.0**2 + 800000.0**2 - (6371000.0 + h) ** 2) / (2 * 800000.0 * 7070000.0)
    for got, h in ((low, 0.0), (high, 1000.0)):
        assert abs(got.y - 800000.0 * np.sqrt(1 - cos(h) ** 2)) < 1e-5 and abs(got.height - h) < 1e-5
    # at one range the higher point lies farther out
    assert high.y > low.y and low.lon > 0
    east = O.forward(point, states, O.RadarGrid(0.0, 100.0, 600000.0, 1.0, "right", 1, 1), 0.0, body).first()
    assert east.x is None and east.height is None
    assert O.forward(point.limit(0), states, grid).collect() == []
    far = spark.createDataFrame([(1.0, 1.0, 1e9), (None, 1.0, 1.0)], "x double, y double, z double")
    assert [(r.az, r.rg) for r in O.inverse(far, states, grid).collect()] == [(None, None)] * 2
    with pytest.raises(Exception, match="even steps"):
        O.orbit_of(states.where("t <> 2")).collect()


def hills(spark, lon, lat, step, shape, gap=False):
    r, c = np.indices(shape)
    v = 800 + 300 * np.sin(r / 9.0) * np.cos(c / 11.0) + 2.0 * c
    if gap:
        v[:, : shape[1] // 2] = np.nan
    df = cells(spark, v).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).where("v is not null")
    return O.Heights(df, lon, lat, step, -step, shape), v


def test_height_model(spark):
    grid = O.RadarGrid(60.0, 1500.0, 850000.0, 6.0, "left", 4000, 3000)
    states = circular(spark)
    points = image_points(spark, 12, 10, 250)
    flat = O.forward(points, states, grid, 800.0).toPandas()
    lon, lat, step = flat["lon"].min() - 0.1, flat["lat"].max() + 0.1, 0.004
    shape = (int((lat - flat["lat"].min() + 0.1) / step), int((flat["lon"].max() + 0.1 - lon) / step))
    model, v = hills(spark, lon, lat, step, shape)
    results = []
    for tile in (32, 4096):
        got = O.forward(points, states, grid, model, tile=tile).toPandas().sort_values(["row", "col"])
        y, x = (lat - got["lat"]) / step, (got["lon"] - lon) / step
        i, j = np.floor(y).astype(int), np.floor(x).astype(int)
        y, x = y - i, x - j
        want = v[i, j] * (1 - y) * (1 - x) + v[i, j + 1] * (1 - y) * x + v[i + 1, j] * y * (1 - x) + v[i + 1, j + 1] * y * x
        assert got["height"].notna().all() and np.abs(got["height"] - want).max() < 0.02
        back = O.inverse(spark.createDataFrame(got), states, grid).toPandas()
        assert np.abs(back["rg"] - back["col"]).max() < 0.01 and np.abs(back["az"] - back["row"]).max() < 0.01
        results.append(got[["x", "y", "z"]].to_numpy())
    assert np.abs(results[0] - results[1]).max() < 1e-6
    gaps = O.forward(points, states, grid, hills(spark, lon, lat, step, shape, True)[0]).toPandas()
    assert 0 < gaps["height"].isna().sum() < len(gaps)
    away = O.forward(points, states, grid, O.Heights(model.cells, lon + 50, lat, step, -step, shape)).toPandas()
    assert away["height"].isna().all()


def test_geocoding_round_trip(spark):
    grid = O.RadarGrid(60.0, 1500.0, 850000.0, 6.0, "left", 300, 200)
    states = circular(spark)
    r, c = np.indices((300, 200))
    image = cells(spark, (r + 1j * c).astype(complex))
    places = spark.range(2000).select((F.col("id") * 0.1493).alias("row"), (F.pmod(F.col("id") * 37.7, F.lit(199.0))).alias("col"))
    ground = O.forward(places, states, grid, 250.0).select("lon", "lat", "height", F.col("row").alias("at"), F.col("col").alias("in"), F.lit(1).alias("re"))
    for tile in (64, 1000):
        out = O.geocoded(ground.drop("re"), image, states, grid, ["re", "im"], tile=tile).toPandas()
        assert len(out) == 2000
        inside = out["at"] <= 299
        assert np.abs(out["re"] - out["at"])[inside].max() < 0.05 and np.abs(out["im"] - out["in"])[inside].max() < 0.05
        assert out["re"][out["at"] > 299.01].isna().all()
    box = []
    some = ground.where("at > 100 and at < 130 and `in` between 20 and 50").select("lon", "lat", "height")
    assert O.geocoded(some, lambda rows, cols: box.append((rows, cols)) or image, states, grid, ["re"]).where("re is null").count() == 0
    assert 99 <= box[0][0][0] <= 102 and 128 <= box[0][0][1] <= 133 and 19 <= box[0][1][0] < box[0][1][1] <= 53
    assert O.geocoded(ground.withColumn("height", F.lit(None).cast("double")), image, states, grid, ["re"]).where("re is not null").count() == 0
    looked = grid.looked((3, 2))
    assert (looked.rows, looked.cols, looked.prf) == (100, 100, 500.0) and abs(looked.sensing_start - 60 - 1 / 1500) < 1e-12


# ---- tiles, resampling -----------------------------------------------------------------------------------------------
def test_tiles(spark):
    a = np.arange(23.0 * 17).reshape(23, 17)
    a[5, 6] = np.nan
    df = cells(spark, a).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).where("not (row = 9 and col = 9)")
    for size, halo in ((5, 2), (8, 0), (100, 3), (4, 6)):
        tiles = T.tile_arrays(df, a.shape, size, halo, ["v"])
        places = spark.range(2300).select(F.pmod(F.col("id") * 0.377, F.lit(22.0)).alias("y"), F.pmod(F.col("id") * 0.733, F.lit(16.0)).alias("x"))
        if halo:
            got = places.join(tiles, (F.floor(F.col("y") / size) == F.col("ty")) & (F.floor(F.col("x") / size) == F.col("tx"))).select("y", "x", T.at_place(F.col("v"), F.col("y"), F.col("x"), a.shape).alias("v")).toPandas()
            assert len(got) == 2300
            i, j = np.floor(got["y"]).astype(int), np.floor(got["x"]).astype(int)
            gone = ((i - 5).isin([0, -1]) & (j - 6).isin([0, -1])) | ((i - 9).isin([0, -1]) & (j - 9).isin([0, -1]))
            assert np.abs(got["v"] - (17 * got["y"] + got["x"]))[~gone].max() < 1e-9 and got["v"][gone].isna().sum() > 10
        mean = T.by_tiles(df, a.shape, size, halo, lambda d, r, c: {"v": d["v"] + 1}, ["v"], ["v"])
        (b,) = dense(mean, a.shape, "v")
        assert mean.count() == a.size and np.isnan(b[9, 9]) and np.nansum(b) == np.nansum(a) - a[9, 9] + a.size - 2


def waves(shape, seed=0, most=0.3):
    """A band-limited random image as a function of fractional places."""
    r = np.random.default_rng(seed)
    ky, kx = r.uniform(-most, most, 40), r.uniform(-most, most, 40)
    amp = r.normal(size=40) + 1j * r.normal(size=40)
    return lambda y, x: sum(a * np.exp(2j * np.pi * (p * y + q * x)) for a, p, q in zip(amp, ky, kx, strict=True))


def test_resampling_a_known_shift(spark):
    shape, lattice = (90, 70), M.Lattice((10.0, 8.0), (20.0, 16.0), (5, 4))
    f = waves(shape)
    y, x = np.indices(shape, float)
    carrier = 0.9
    image = f(y, x) * np.exp(1j * carrier * y)
    i, j = np.indices(lattice.shape)
    az, rg = 7.3 + 0.05 * i, -11.6 + 0.03 * j
    offsets = cells(spark, az).withColumnRenamed("v", "az").join(cells(spark, rg).withColumnRenamed("v", "rg"), ["row", "col"])
    out = []
    for tile in (16, 37, 500):
        re, im = dense(M.resampled_image(cells(spark, image), offsets, lattice, shape, carrier=carrier, tile=tile), shape, "re", "im")
        out.append(re + 1j * im)
    ok = np.isfinite(out[0])
    assert all(np.array_equal(np.isfinite(o), ok) and np.abs(o - out[0])[ok].max() < 1e-9 for o in out) and ok.mean() > 0.6
    t = np.clip((y - 10) / 20, 0, 4), np.clip((x - 8) / 16, 0, 3)
    yy, xx = y + 7.3 + 0.05 * t[0], x - 11.6 + 0.03 * t[1]
    want = f(yy, xx) * np.exp(1j * carrier * yy)
    assert np.abs(out[0] - want)[ok].max() < 0.02 * np.abs(want).max()
    # how far what came out lies off along each axis, by least squares against the image's own slope: below 0.01 cells
    for dy, dx in ((1e-4, 0.0), (0.0, 1e-4)):
        slope = (f(yy + dy, xx + dx) - f(yy - dy, xx - dx)) / 2e-4
        off = (slope.conj() * (out[0] - want) * np.exp(-1j * carrier * yy))[ok].sum().real / (np.abs(slope[ok]) ** 2).sum()
        assert abs(off) < 0.002
    assert M.resampled_image(cells(spark, image).limit(0), offsets, lattice, shape).where("re <> 0").count() == 0
    inside = M.resampled_image(cells(spark, image), offsets, lattice, (20, 20), shape)
    assert inside.count() == 20 * (20 - 16) or inside.agg(F.max("row")).first()[0] == 19


def test_coregistration_settles(spark):
    shape, lattice = (96, 96), M.Lattice((0.0, 0.0), (24.0, 24.0), (5, 5))
    f = waves(shape, 3, 0.2)
    y, x = np.indices(shape, float)
    ref, sec = cells(spark, f(y, x)), cells(spark, f(y - 2.3, x + 1.4))
    nought = cells(spark, np.zeros(lattice.shape)).select("row", "col", F.col("v").alias("az"), F.col("v").alias("rg"))
    amplitude = lambda df: df.select("row", "col", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("v"))
    from tessera.plans.routes import match_windows

    measure = lambda made: match_windows(amplitude(ref), amplitude(made), 24, 6, 10, shape).where("snr > 4")
    made, offsets, seen = M.coregistered(sec, nought, lattice, shape, measure, 0.05, 8, least=5)
    assert max(abs(seen[-1][0]), abs(seen[-1][1])) < 0.05 < max(abs(seen[0][0]), abs(seen[0][1]))
    got = offsets.toPandas()
    assert np.abs(got["az"] - 2.3).max() < 0.15 and np.abs(got["rg"] + 1.4).max() < 0.15
    with pytest.raises(RuntimeError, match="settle"):
        M.coregistered(sec, nought, lattice, shape, lambda m: measure(m).withColumn("azimuth", F.lit(3.0)), 0.05, 2, least=5)
    with pytest.raises(Exception, match="too few"):
        M.coregistered(sec, nought, lattice, shape, lambda m: measure(m).limit(2), 0.05, 2)


# ---- patches, refocusing ---------------------------------------------------------------------------------------------
def brute_patches(z, alpha, nfft, step, least, beta, window):
    n, m = z.shape
    half = nfft // 2
    p = np.pad(z, nfft)
    taper = np.outer(np.kaiser(nfft, beta), np.kaiser(nfft, beta))
    out = np.zeros_like(z)
    for r in range(n):
        for c in range(m):
            # the centre whose block holds the cell
            i, j = (r + step // 2) // step * step, (c + step // 2) // step * step
            patch = p[i + nfft - half : i + nfft + half, j + nfft - half : j + nfft + half]
            if np.count_nonzero(patch) >= int(least * nfft * nfft):
                s = np.fft.fft2(patch * taper)
                out[r, c] = np.fft.ifft2(s * np.abs(s) ** alpha)[r - i + half, c - j + half]
    k = len(window) // 2
    q = np.pad(out, k)
    coh = np.zeros(z.shape)
    for r in range(n):
        for c in range(m):
            box = q[r : r + 2 * k + 1, c : c + 2 * k + 1]
            size = (np.abs(box) * window).sum()
            coh[r, c] = abs((box * window).sum()) / size if size else 0
    return np.where(out != 0, out / np.where(out == 0, 1, np.abs(out)) * coh, 0), coh


def test_patch_filter_equals_the_whole_grid(spark):
    r = np.random.default_rng(4)
    y, x = np.indices((44, 38))
    z = np.exp(1j * (y / 4 + x / 7 + r.normal(0, 0.7, y.shape)))
    z[10:22, 5:19] = 0
    want, coh = brute_patches(z, 0.6, 16, 4, 0.7, 2.12, np.ones((5, 5)))
    for tile in (10, 16, 200):
        df = P.patch_filtered(cells(spark, z).where("re <> 0 or im <> 0"), z.shape, 0.6, 16, 4, 0.7, 2.12, np.ones((5, 5)), tile)
        re, im, c = dense(df, z.shape, "re", "im", "coh")
        assert np.abs(np.nan_to_num(re) + 1j * np.nan_to_num(im) - want).max() < 1e-9 and np.abs(np.nan_to_num(c) - np.where(want == 0, 0, coh)).max() < 1e-9
    noise = P.phase_noise(cells(spark, z), df).first()
    assert 0.3 < noise.rms < 1.2 and noise.n > 500
    assert P.patch_filtered(cells(spark, z).limit(0), z.shape).count() == 0


BAND = R.Band(1520.0, 1262.5, -557.0, 4.44)
LATTICE = M.Lattice((96.0, 0.0), (16.0, 16.0), (80, 8))


def steered(n=1600, m=64):
    """A random image within the band, a steering field, and the image as the layer bends it."""
    r = np.random.default_rng(0)
    t = np.arange(n) / BAND.prf
    spectrum = r.normal(size=(n, m)) + 1j * r.normal(size=(n, m))
    spectrum[np.abs(np.fft.fftfreq(n, 1 / BAND.prf)) > BAND.bandwidth / 2] = 0
    image = np.fft.ifft(spectrum, axis=0) * np.exp(2j * np.pi * BAND.centre * t)[:, None]
    i = np.arange(LATTICE.shape[0])
    field = (-3.0 / (1 + np.exp(-(i - 15) / 3.0)) + 3.0 / (1 + np.exp(-(i - 35) / 4.0)))[:, None] + np.zeros((1, LATTICE.shape[1]))
    return image, field


def whole(image, field, along, block=240, hop=120, gain=1.0):
    return R._whole(image, 0, 0, R.Nodes(field, 0, 0), LATTICE, BAND, along, block, hop, gain)


def test_refocusing_of_tables(spark):
    image, field = steered()
    nodes = cells(spark, field)
    bent = whole(image, -field, 3.0)
    for strip in (20, 1000):
        re, im = dense(R.refocused(cells(spark, bent), nodes, LATTICE, bent.shape, BAND, 3.0, strip=strip), bent.shape, "re", "im")
        assert np.abs(re + 1j * im - whole(bent, field, 3.0)).max() < 1e-9 or strip == 20
        coh = lambda a, b: abs((a * b.conj()).sum()) / np.sqrt((abs(a) ** 2).sum() * (abs(b) ** 2).sum())
        assert coh(image, re + 1j * im) > 0.97 > coh(image, bent) + 0.02 and coh(image, whole(bent, -field, 3.0)) < coh(image, bent)
    re, im = dense(R.refocused(cells(spark, bent[:301]), nodes, LATTICE, (301, 64), BAND, 0.0, strip=64), (301, 64), "re", "im")
    assert np.abs(re + 1j * im - bent[:301]).max() < 1e-12
    gains = spark.createDataFrame([(k, 0, 0.0) for k in range(6)], "gi int, gj int, gain double")
    re, im = dense(R.refocused(cells(spark, bent), nodes, LATTICE, bent.shape, BAND, 3.0, gains=gains), bent.shape, "re", "im")
    assert np.abs(re + 1j * im - bent).max() < 1e-9
    with pytest.raises(ValueError, match="fewer"):
        R.refocused(cells(spark, bent), nodes, LATTICE, (100, 64), BAND, 3.0)


def pair_of(spark, a, b):
    return cells(spark, a, re="a_re", im="a_im").join(cells(spark, b, re="b_re", im="b_im"), ["row", "col"])


def test_gate_in_both_directions(spark, tmp_path, capsys):
    image, field = steered()
    bent = whole(image, -field, 3.0)
    options = dict(block=240, hop=120, samples=64, picks=2, sweep=(0.0, 1.5, 3.0), looks=(24, 16))
    out, told = R.refocus(pair_of(spark, image, bent), cells(spark, field), LATTICE, bent.shape, BAND, least_spread=0.1, **options)
    assert told["refocused"] and told["along_km"] == 3.0 and told["gained"] > 0.05
    re, im = dense(out, bent.shape, "re", "im")
    near = lambda z: np.abs(z - image).mean()
    assert near(re + 1j * im) < 0.6 * near(bent)
    from tessera.cli import main

    pair_of(spark, image, image).write.parquet(f"{tmp_path}/pair")
    cells(spark, field).write.parquet(f"{tmp_path}/field")
    command = ["refocus", f"{tmp_path}/pair", f"{tmp_path}/field", f"{tmp_path}/out", "--shape", "1600,64", "--origin", "96,0", "--centre", "-557", "--samples", "64", "--picks", "1"]
    assert main(command) == 0 and "along_km=0.0" in (told := capsys.readouterr().out) and "refocused=False" in told
    with pytest.raises(SystemExit, match="needs"):
        main(command[:3])
    same, told = R.refocus(pair_of(spark, image, image), cells(spark, field), LATTICE, bent.shape, BAND, **options)
    assert not told["refocused"] and told["along_km"] == 0.0
    re, im = dense(same, bent.shape, "re", "im")
    assert np.array_equal(re + 1j * im, image)
    kept = R.local_gains(pair_of(spark, image, image), cells(spark, field), LATTICE, bent.shape, BAND, 3.0, samples=64, least_spread=0.1).collect()
    assert len(kept) == 6 and {g.gain for g in kept if g.coherences} == {0.0} and all(g.gain == 1.0 for g in kept if not g.coherences)


# ---- the interferogram of two granules -------------------------------------------------------------------------------
def scene(spark, folder):
    """Two granules of one scene from orbits 80 m apart: the same waves on the ground, turned by the difference of ranges."""
    wavelength, shape = 0.25, (150, 120)
    grids = [O.RadarGrid(60.0, 1500.0, 850000.0, 4.0, "left", *shape), O.RadarGrid(60.004, 1500.0, 850020.0, 4.0, "left", 170, 140)]
    states = [circular(spark), circular(spark, higher=80.0)]
    f = waves(shape, 6, 0.2)
    y, x = np.indices((170, 140), float)
    points = spark.createDataFrame(pd.DataFrame({"row": y.ravel().astype(np.int32), "col": x.ravel().astype(np.int32)}))
    at = O.inverse(O.forward(points, states[1], grids[1], 0.0), states[0], grids[0])
    r, c = dense(at, (170, 140), "az", "rg")
    more = (850020.0 + 4.0 * x) - (850000.0 + 4.0 * c)
    images = [f(*np.indices(shape, float)), f(r, c) * np.exp(-4j * np.pi / wavelength * more)]
    for k, (name, grid, image) in enumerate(zip(("ref", "sec"), grids, images, strict=True)):
        path = f"{folder}/{name}"
        G.write_image(cells(spark, image), path, "slc", image.shape, (64, 64))
        G.write_attributes(path, "radargrid", {"sensing_start": grid.sensing_start, "wavelength": wavelength, "prf": grid.prf, "starting_range": grid.starting_range, "range_pixel_spacing": 4.0, "lookside": "left", "length": grid.rows, "width": grid.cols, "ref_epoch": "2025-01-01"})
        rows = states[k].toPandas()
        for key, columns in (("time", ["t"]), ("position", ["x", "y", "z"]), ("velocity", ["vx", "vy", "vz"])):
            v = rows[columns].to_numpy()
            G.write_array(path, f"orbit/{key}", v[:, 0] if key == "time" else v)
        G.close_granule(path)
    ground = O.forward(points.where("row % 10 = 5 and col % 8 = 3 and row < 140 and col < 110"), states[0], grids[0], 0.0)
    return ground.select("lon", "lat", F.lit(0.0).alias("height"), F.col("row").alias("at"), F.col("col").alias("in"))


def test_interferogram_of_granules(spark, tmp_path, capsys):
    from tessera.plans.products import Options, interferogram

    ground = scene(spark, tmp_path)
    run = lambda cells=None, **options: interferogram(spark, f"{tmp_path}/ref", f"{tmp_path}/sec", f"{tmp_path}/out", Options(**({"skip": (40, 40), "looks": (6, 5), "alpha": 0.2, "nfft": 8, "tile": 64} | options)), cells=cells)
    made, log = run(ground)
    assert [reused for _, _, reused in log] == [False] * 5 and [n for n, _, _ in log] == ["offsets", "resampled", "looks", "filtered", "map"]
    moved = made["offsets"].agg(F.min("az"), F.max("az"), F.min("rg"), F.max("rg")).first()
    assert all(v is not None for v in moved) and abs(moved[0]) > 1 and max(map(abs, moved)) < 80
    looks = made["looks"].where("row between 4 and 20 and col between 4 and 19").toPandas()
    phase = np.angle(looks["z_re"] + 1j * looks["z_im"])
    assert len(looks) == 17 * 16 and looks["coh"].min() > 0.9 and looks["coh"].median() > 0.99
    assert np.abs(phase).max() < 0.15 and np.abs(np.median(phase)) < 0.02
    on_map = made["map"].where("at between 30 and 110 and `in` between 30 and 90").toPandas()
    assert len(on_map) > 50 and on_map["re"].notna().all() and np.abs(np.angle(on_map["re"] + 1j * on_map["im"])).max() < 0.15
    assert [r for _, _, r in run(ground)[1]] == [True] * 5
    assert [(n, r) for n, _, r in run(ground, alpha=0.4)[1] if not r] == [("filtered", False), ("map", False)]
    assert [n for n, _, r in run(looks=(5, 5))[1] if not r] == ["looks", "filtered"]
    from tessera.cli import main

    command = ["interferogram", f"{tmp_path}/ref", f"{tmp_path}/sec", f"{tmp_path}/out", "--skip", "40,40", "--looks", "6,5", "--alpha", "0.2", "--nfft", "8"]
    assert main(command) == 0 and [x.split()[1] for x in capsys.readouterr().out.splitlines()[-4:]] == ["reused"] * 4
    assert [n for n, _, r in run(ground.limit(20))[1] if not r] == ["map"]
    # a table without its mark is made again, and so is all that stands on a granule that changed
    done = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("resampled"))
    (done / "_SUCCESS").unlink()
    assert [n for n, _, r in run()[1] if not r] == ["resampled"]
    G.write_attributes(f"{tmp_path}/sec", "note", {"touched": 1})
    assert [n for n, _, r in run()[1] if not r] == ["offsets", "resampled", "looks", "filtered"]


def test_fingerprints(spark):
    from tessera.sources.provenance import table_fingerprint

    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    same = table_fingerprint(a)
    assert same == table_fingerprint(a.orderBy(F.desc("k")).repartition(3))
    others = [a.distinct(), a.withColumnRenamed("v", "w"), a.withColumn("k", F.col("k").cast("long")), a.where("k = 1"), a.fillna("")]
    assert len({same, *map(table_fingerprint, others)}) == 6


def test_coregister_command_applies_its_offsets(spark, tmp_path):
    from tessera.cli import main

    shape = (96, 96)
    f = waves(shape, 3, 0.2)
    y, x = np.indices(shape, float)
    cells(spark, f(y, x)).write.parquet(f"{tmp_path}/ref")
    cells(spark, f(y - 2.0, x + 1.0)).write.parquet(f"{tmp_path}/sec")
    assert main(["coregister", f"{tmp_path}/ref", f"{tmp_path}/sec", f"{tmp_path}/out", "--shape", "96,96", "--window", "24", "--search", "6", "--skip", "10", "--snr", "2", "--apply"]) == 0
    re, im = dense(spark.read.parquet(f"{tmp_path}/out/resampled"), shape, "re", "im")
    inner = np.isfinite(re) & (np.hypot(y - 48, x - 48) < 30)
    off = lambda z: np.abs(z - f(y, x))[inner].mean()
    assert inner.sum() > 2000 and off(re + 1j * im) < 0.25 * off(f(y - 2.0, x + 1.0))
