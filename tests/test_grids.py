"""GeoTIFF files, geometry and delay checks."""

import os
import struct
import zlib

import duckdb
import numpy as np
import pytest

from tessera import plans
from tessera.operators import geometry as G
from tessera.operators import kernels as K
from tessera.sources import geotiff as T

SF = "/root/testdata/sf0.01"
NAMES = ["k01_geotiff", "s11_block_raster", "j14_resample_bilinear", "j15_warp_nearest", "j18_cube_directions", "f08_integration_geometry", "f28_delay_differences", "p12_solve_domain", "k07_applied_state"]


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
    assert rows and rows_of(rows, df.columns) == rows_of(rel.fetchall(), rel.columns)


def table(spark, a):
    return spark.createDataFrame(K.to_long(a, grid_id="g"), "grid_id string, row int, col int, v double").where("v is not null")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r.v is None else r.v
    return out


GT = (100.0, 30.0, 0.0, 900.0, 0.0, -30.0)


@pytest.mark.parametrize("big", [False, True])
def test_round_trip(spark, tmp_path, monkeypatch, big):
    if big:
        monkeypatch.setattr(T, "BIG", 0)
    a = np.random.default_rng(0).normal(size=(70, 45)).astype(np.float32).astype(float)
    a[:32, :16] = np.nan
    a[50, 40] = np.nan
    path = str(tmp_path / "a.tif")
    assert T.write_geotiff(table(spark, a), path, a.shape, GT, 32606, -9999.0, block=16) == os.path.getsize(path)
    head = T.geotiff_header(path)
    assert (head.shape, head.transform, head.epsg, head.nodata, head.block) == (a.shape, GT, 32606, -9999.0, (16, 16))
    np.testing.assert_array_equal(array(T.read_geotiff(spark, path), a.shape), a)
    part = T.read_geotiff(spark, path, (20, 61), (10, 33))
    want = np.full(a.shape, np.nan)
    want[20:61, 10:33] = a[20:61, 10:33]
    assert part.count() == 41 * 23
    np.testing.assert_array_equal(array(part, a.shape), want)
    assert T.read_geotiff(spark, path, (5, 5)).count() == 0
    T.write_geotiff(table(spark, a), path, a.shape, GT, 4326, block=16)
    assert T.geotiff_header(path).epsg == 4326 and T.geotiff_header(path).nodata is None
    np.testing.assert_array_equal(array(T.read_geotiff(spark, path), a.shape), np.nan_to_num(a))


def test_complex_and_empty_grids(spark, tmp_path):
    path = str(tmp_path / "c.tif")
    rows = [(r, c, float(r), -float(c)) for r in range(20) for c in range(9)]
    T.write_geotiff(spark.createDataFrame(rows, "row int, col int, re double, im double"), path, (20, 9), GT, 3413, block=16)
    got = {(r.grid_id, r.row, r.col): r.v for r in T.read_geotiff(spark, path).collect()}
    assert got == {(g, r, c): v for r, c, re, im in rows for g, v in (("re", re), ("im", im))}
    T.write_geotiff(spark.createDataFrame([], "row int, col int, v double"), path, (20, 9), GT, 3413, float("nan"), block=16)
    assert {r.v for r in T.read_geotiff(spark, path).collect()} == {None}
    for bad in (dict(transform=(0, 1, 0.5, 0, 0, -1), epsg=3413), dict(transform=GT, epsg=0)):
        with pytest.raises(ValueError):
            T.write_geotiff(table(spark, np.ones((2, 2))), path, (2, 2), **bad)
    with pytest.raises(Exception, match="outside the grid"):
        T.write_geotiff(table(spark, np.ones((3, 2))), path, (2, 2), GT, 3413)


@pytest.mark.parametrize("packed", [False, True])
def test_strips_of_another_byte_order(spark, tmp_path, packed):
    a = np.arange(35, dtype=">i2").reshape(7, 5)
    strips = [a[k : k + 3].tobytes() for k in (0, 3, 6)]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    at = np.cumsum([8, *map(len, strips)])
    lists = struct.pack(">6I", *at[:3], *map(len, strips))
    tags = [(256, 3, 1, 5 << 16), (257, 3, 1, 7 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, (8 if packed else 1) << 16), (273, 4, 3, int(at[3])), (277, 3, 1, 1 << 16), (278, 3, 1, 3 << 16), (279, 4, 3, int(at[3]) + 12), (339, 3, 1, 2 << 16)]
    where = int(at[3]) + len(lists)
    raw = struct.pack(">2sHI", b"MM", 42, where) + b"".join(strips) + lists + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0" * 4
    (tmp_path / "s.tif").write_bytes(raw)
    np.testing.assert_array_equal(array(T.read_geotiff(spark, str(tmp_path / "s.tif")), (7, 5)), a.astype(float))
    assert T.geotiff_header(str(tmp_path / "s.tif")).transform is None
    with pytest.raises(ValueError, match="isn't a TIFF"):
        (tmp_path / "x.tif").write_bytes(b"no such file at all")
        T.geotiff_header(str(tmp_path / "x.tif"))


def test_open_raster_knows_plain_files(spark, tmp_path):
    a = np.arange(60, dtype=np.float32).reshape(12, 5)
    plain, tif = str(tmp_path / "p.bin"), str(tmp_path / "p.tif")
    a.tofile(plain)
    T.write_geotiff(table(spark, a.astype(float)), tif, a.shape, GT, 3413, block=16)
    for path in (plain, tif):
        got = T.open_raster(spark, path, a.shape, "float32", slice(-5, -1), (1, 4))
        assert {(r.row, r.col): r.v for r in got.collect()} == {(r, c): float(a[r, c]) for r in range(7, 11) for c in range(1, 4)}
        assert T.open_raster(spark, path, a.shape, "float32", slice(4, 2)).count() == 0
    with pytest.raises(ValueError, match="contiguous"):
        T.open_raster(spark, plain, a.shape, "float32", slice(0, 6, 2))
    with pytest.raises(ValueError, match="not"):
        T.open_raster(spark, tif, (5, 12), "float32")


def test_delays_have_to_agree(spark):
    make = lambda rows: spark.createDataFrame(rows, "freq string, d string, delay double, bandwidth double")
    G.check_delay(make([("A", "1", 2.0, 2e7), ("A", "2", 2.0 + 1e-8, 2e7), ("B", "1", 1.0, 5e6), ("B", "2", None, 5e6)]))
    G.check_delay(make([]))
    with pytest.raises(ValueError, match=r"A 2 9\.4948 m \(1\.00 cells\)"):
        G.check_delay(make([("A", "1", 2.0, 2e7), ("A", "2", 2.0 + G.LIGHT / 4e7, 2e7)]))


def test_mosaic_of_parts(spark, tmp_path):
    a = np.round(np.random.default_rng(2).normal(size=(75, 50)), 3).astype(np.float32).astype(float)
    a[40:, 30:] = np.nan
    path = f"{tmp_path}/m.vrt"
    n = T.write_mosaic(table(spark, a), path, a.shape, GT, 32606, -9999.0, block=8, part=24)
    shape, transform, epsg, parts = T.mosaic_header(path)
    assert shape == a.shape and transform == GT and epsg == 32606 and len(parts) == 12 and n == sum(os.path.getsize(p[0]) for p in parts)
    inner = next(p for p in parts if p[1:] == (24, 48))
    head = T.geotiff_header(inner[0])
    assert head.shape == (24, 2) and head.transform == (GT[0] + 48 * GT[1], GT[1], 0.0, GT[3] + 24 * GT[5], 0.0, GT[5])
    got = T.read_geotiff(spark, path)
    assert got.count() == a.size
    np.testing.assert_array_equal(array(got, a.shape), a)
    box = T.read_geotiff(spark, path, (20, 61), (10, 33)).collect()
    assert len(box) == 41 * 23 and all((r.v is None) == bool(np.isnan(a[r.row, r.col])) and (r.v is None or r.v == a[r.row, r.col]) for r in box)
    assert T.open_raster(spark, path, a.shape, "float32", slice(-5, None)).count() == 5 * 50
    with pytest.raises(ValueError, match="too many"):
        T.write_geotiff(table(spark, a), f"{tmp_path}/x.tif", (5000, 5000), GT, 32606)
    with pytest.raises(ValueError, match="whole blocks"):
        T.write_mosaic(table(spark, a), path, a.shape, GT, 32606, block=16, part=24)
    z = spark.createDataFrame([(3, 30, 1.5, -2.0), (0, 0, 1.0, None)], "row int, col int, re double, im double")
    T.write_mosaic(z, f"{tmp_path}/z.vrt", (20, 40), GT, 3413, block=8, part=16)
    got = {(r.grid_id, r.row, r.col): r.v for r in T.read_geotiff(spark, f"{tmp_path}/z.vrt").where("v <> 0").collect()}
    assert got == {("re", 3, 30): 1.5, ("im", 3, 30): -2.0, ("re", 0, 0): 1.0}
    assert T.write_mosaic(z.limit(0), f"{tmp_path}/e.vrt", (20, 40), GT, 3413, block=8, part=16) > 0
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith(".part")]


def test_harmonic_fill_by_tiles_equals_the_whole_grid(spark):
    from tessera.operators.harmonic import harmonic_fill

    y, x = np.indices((70, 61))
    a = 0.05 * y + np.sin(x / 9.0) * np.cos(y / 13.0)
    hole = np.random.default_rng(3).random(a.shape) < 0.3
    hole[20:45, 15:50] = hole[60:, :20] = True
    a[hole] = np.nan
    want = K.graph_fill(a, iterations=50_000, tol=1e-13)
    for tile, halo in ((16, 8), (24, 4), (200, 0)):
        got = harmonic_fill(table(spark, a), a.shape, tile, halo)
        assert got.count() == a.size and np.abs(array(got, a.shape) - want).max() < 1e-4 * np.ptp(want)
    assert harmonic_fill(table(spark, a).limit(0), (5, 4), 2, 1).where("v is null").count() == 20
    with pytest.raises(RuntimeError, match="settle"):
        harmonic_fill(table(spark, a), a.shape, 8, 1, rounds=1)
