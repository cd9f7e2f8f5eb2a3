"""Raster operators: queries against their SQL, planted signals, and rules that must hold."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import blocks as B
from tessera.operators import fixpoint as P
from tessera.operators import joins as J
from tessera.operators import kernels as K
from tessera.operators import stencil as T
from tessera.plans import fixtures as X
from tessera.plans import routes as Z
from tessera.sources import io as IO
from tessera.streaming.accumulation import accumulate_stream

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(round(r[k], 9) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


@needs_data
@pytest.mark.parametrize("name", ["a01_block_sum", "a08_leave_one_out", "a10_regression_removal", "e01_pair_index", "j06_bilinear_lookup", "j10_point_in_polygon", "j13_bracket_interpolation", "w01_box_mean", "w03_spikes", "w04_gaussian_lowpass", "w07_carry_across", "r01_components", "r05_despike", "r06_block_outliers", "r10_distance", "f13_split_solve", "t02_separated_peaks"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, rel = plans.QUERIES[name](spark, SF), con.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(rel.fetchall(), rel.columns)


def test_bracket_on_a_long_axis_with_wide_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "RANGE_ROWS", 100, raising=False)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS s_suppkey, CASE WHEN k % 17 <> 0 THEN k * 37 % 1009 / 8.0 END::DOUBLE AS s_acctbal FROM (SELECT unnest(range(1200)) AS k UNION ALL SELECT 3000000 UNION ALL SELECT 3000001 UNION ALL SELECT NULL)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT k AS p_partkey FROM (SELECT unnest(range(0, 300000, 150)) AS k UNION ALL SELECT 5 FROM range(300) UNION ALL SELECT 1000000000000 UNION ALL SELECT 4000000000000 UNION ALL SELECT NULL)) TO '{tmp_path}/part.parquet'")
    for f in ("supplier", "part"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{tmp_path}/{f}.parquet'")
    df, rel = plans.QUERIES["j13_bracket_interpolation"](spark, str(tmp_path)), con.sql(plans.ORACLE_SQL["j13_bracket_interpolation"])
    got = rows_of(df.collect(), df.columns)
    assert len(got) == 2303 and got == rows_of(rel.fetchall(), rel.columns)


def test_leave_one_out_of_values_that_change_when_worked_out_again(spark):
    # each evaluation adds other last digits, as sums in another order do
    other = F.udf(lambda v: None if v is None else v + np.random.default_rng().uniform(-1, 1) * 1e-9, "double").asNondeterministic()
    rng = np.random.default_rng(3)
    rows = [(f"p{k:02}", r, 0, None if (k + r) % 5 == 0 else float(rng.normal())) for r in range(6) for k in range(2 * r + 1)]
    df = spark.createDataFrame(rows, "pair string, row int, col int, l double")
    got = {(r.pair, r.row): r.loo for r in B.leave_one_out_median(df.withColumn("l", other("l"))).collect()}
    assert len(got) == len(rows)
    for pair, row, _, value in rows:
        rest = [v for p, r, _, v in rows if r == row and p != pair and v is not None]
        want = None if value is None or not rest else float(np.median(rest))
        assert (got[pair, row] is None) == (want is None) and (want is None or abs(got[pair, row] - want) < 1e-8)


def grid_df(spark, a):
    return spark.createDataFrame(K.to_long(a, grid_id="g"), "grid_id string, row int, col int, v double")


def test_components_of_a_snake(spark):
    a = np.full((20, 20), np.nan)
    for r in range(0, 20, 2):
        a[r] = 1
        a[r + 1, 19 if r % 4 == 0 else 0] = 1
    cells = grid_df(spark, a).where("v is not null").select("row", "col")
    assert {r.label for r in P.label_components(cells, 20).collect()} == {0}


def test_interior_holes_only(spark):
    a = np.ones((12, 12))
    a[4:7, 4:7] = np.nan
    a[0:3, 9:12] = np.nan
    got = K.to_grid(P.fill_interior(grid_df(spark, a).select("row", "col", "v"), 12, 12).toPandas())
    assert np.isfinite(got[4:7, 4:7]).all() and np.isnan(got[0:3, 9:12]).all()


def test_gaussian_frames_equal_the_kernel(spark):
    a = np.random.default_rng(0).normal(size=(24, 18))
    a[5:9, 3:6] = np.nan
    got = K.to_grid(T.gaussian(grid_df(spark, a).drop("grid_id"), a.shape, (1.0, 1.5)).withColumnRenamed("low", "v").toPandas())
    assert np.nanmax(np.abs(got - K.lowpass(a, (1.0, 1.5)))) < 5e-3


def test_screen_and_its_inverse_are_the_identity(spark):
    ifg = spark.range(50).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.sin("id").alias("re"), F.cos("id").alias("im"))
    screen = ifg.select("row", "col", (F.col("row") / 7.0).alias("screen"))
    back = Z.apply_screen(Z.apply_screen(ifg, screen), screen, 1.0)
    assert back.join(ifg.withColumnsRenamed({"re": "a", "im": "b"}), ["row", "col"]).where((F.abs(F.col("re") - F.col("a")) > 1e-12) | (F.abs(F.col("im") - F.col("b")) > 1e-12)).count() == 0


def test_planted_direction():
    y, x = np.indices((128, 128))
    for angle in (-60, -15, 30, 80):
        t = np.radians(angle)
        r, theta, d = K.directionality(np.cos(2 * np.pi * 0.1 * (x * np.cos(t) - y * np.sin(t))))
        assert abs(theta - angle) < 1 and r > 0.9 and abs(d - r * np.cos(2 * t)) < 0.05


@pytest.mark.parametrize("method", sorted(K.FILLS))
def test_fills_keep_measured_cells(method):
    y, x = np.indices((48, 48))
    true = np.sin(x / 9) + np.cos(y / 11)
    a = true.copy()
    a[18:28, 20:30] = np.nan
    z = K.fill(a, method)
    ok = np.isfinite(a)
    assert (z[ok] == a[ok]).all() and np.isfinite(z).all()
    assert np.abs(z - true)[~ok].mean() < 0.6
    with pytest.raises(ValueError, match="no fill method"):
        K.fill(a, "unheard of")


def test_unwrapping_is_congruent():
    y, x = np.indices((64, 64))
    true = 0.3 * x + 0.2 * y + ((x - 32) / 10) ** 2
    got = K.unwrap(np.angle(np.exp(1j * true)))
    assert np.ptp(got - true) < 1e-9


def test_refocusing_restores_coherence():
    got = Z.refocus_self_test()
    assert got["identity"] < 1e-5 and got["distorted"] < 0.9 and got["refocused"] > 0.95 and got["wrong"] < got["distorted"]


def test_matching_finds_a_shift(spark):
    a = np.abs(np.random.default_rng(1).normal(size=(96, 96)))
    found = Z.match_windows(grid_df(spark, a), grid_df(spark, np.roll(a, (2, -3), (0, 1))), 24, 6, 20, a.shape).collect()
    assert found and all(abs(r.azimuth - 2) < 0.2 and abs(r.range + 3) < 0.2 for r in found)


def test_split_route_recovers_the_planted_screen(spark):
    y, x = np.indices((40, 32))
    disp, non = 2.0 * np.sin(x / 12.0) + y / 20.0, 0.05 * x
    f0, f1 = X.FA, X.FB
    pa, pb = non + disp, non * f1 / f0 + disp * f0 / f1
    g = lambda a, n: grid_df(spark, a).drop("grid_id").withColumnRenamed("v", n)
    bands = g(pa, "phi_a").join(g(pb, "phi_b"), ["row", "col"]).withColumn("coh", F.lit(0.9))
    out = Z.split_screen(bands, f0, f1, (40, 32), sigma=1.0, box=1).toPandas()
    got = K.to_grid(out.assign(v=out["screen"]))
    assert np.std((got - disp)[5:-5, 5:-5]) < 0.2 * np.std(disp)


def test_filled_is_not_kept(spark):
    r = np.random.default_rng(2)
    a = np.cumsum(r.normal(size=(40, 30)), axis=0) * 0.1
    lat = grid_df(spark, a).select("row", "col", F.col("v").alias("azimuth"), (F.col("v") * 0.1).alias("range"), F.lit(9.0).alias("snr"), ((F.col("row") - 15) ** 2 + (F.col("col") - 15) ** 2 > 20).alias("keep"))
    out = Z.fill_channels(lat, robust=0)
    assert out.where(F.col("filled") == F.col("keep")).count() == 0
    j = out.join(lat.select("row", "col", F.col("azimuth").alias("was"), F.col("keep").alias("k")), ["row", "col"])
    assert j.where(F.col("k") & (F.abs(F.col("azimuth") - F.col("was")) > 1e-12)).count() == 0 and j.where("azimuth is null").count() == 0


def test_tiles_and_files_round_trip(spark, tmp_path):
    a = np.arange(35.0).reshape(5, 7)
    a[2, 3] = np.nan
    df = grid_df(spark, a)
    assert np.array_equal(K.to_grid(IO.untiled(IO.tiles(df, 3), 3).toPandas()), a, equal_nan=True)
    IO.write_npz(str(tmp_path / "x.npz"), a=a, window=np.array([3, 4]), az_spacing=4.5)
    assert np.array_equal(K.to_grid(IO.read_npz(spark, str(tmp_path / "x.npz")).toPandas()), a, equal_nan=True)
    assert {(r.key, r.value) for r in IO.read_npz_scalars(spark, str(tmp_path / "x.npz")).collect()} == {("window[0]", 3.0), ("window[1]", 4.0), ("az_spacing", 4.5)}
    np.arange(24, dtype=np.float32).reshape(6, 4).tofile(tmp_path / "f.bin")
    assert K.to_grid(IO.read_flat(spark, str(tmp_path / "f.bin"), (6, 4), "float32", 2).toPandas()).tolist() == np.arange(24.0).reshape(6, 4).tolist()
    assert IO.header_shape(IO.header_text("f.bin", (6, 4), "float32")) == (6, 4)


def test_config(tmp_path):
    p = tmp_path / "pair.yaml"
    p.write_text("track: 87\nframe: 57\ndates: [20260714, 20260726]\npol: HH\ngpus: '0'\nrefocus_km: auto\nfill: {cutoff: 30, aniso: auto}\nsplit: {unwrap_diff: false}\n")
    c = IO.read_config(str(p))
    assert c.tag == "t087_20260714_20260726" and c.fill == {"cutoff": 30, "aniso": "auto"} and c.offsets == "outputs_offsets/offsets_t087_20260714_20260726.npz"
    assert (c.posting, c.looks, c.hybrid_cut_km, c.grid_epsg, c.refocus) == (120.0, (24, 16), 32.0, 3413, None)
    assert c.grid == "cache/grid_t087_f057_120m_3413.tif"
    p.write_text("track: '029'\nframe: 35\ndates: ['2026-07-22', '2026-08-15']\nrefocus_km: 350\ntag: own\n")
    c = IO.read_config(str(p))
    assert c.tag == "own" and c.track == 29 and c.refocus == 350.0 and c.scratch == "offsets_scratch_20260722_20260815"
    for text, what in (("track: 1\nframe: 2\ndates: [1, 2]\nnonsense: 1\n", "unknown"), ("track: 1\nframe: 2\n", "missing"), ("track: 1\nframe: 2\ndates: [1]\n", "two dates")):
        p.write_text(text)
        with pytest.raises(ValueError, match=what):
            IO.read_config(str(p))


def test_a_date_in_many_batches_is_kept_whole(spark, tmp_path):
    schema = "freq string, d string, row int, col int, re double, im double"
    r = np.random.default_rng(4)
    rows = [("A", d, i, j, *r.normal(size=2).tolist()) for d in ("20260101", "20260113") for i in range(6) for j in range(6)]
    for k in range(4):
        # every batch has some rows of both dates
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    accumulate_stream(stream, f"{tmp_path}/store", 2, 3, f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store/samples").count() == 72
    key = lambda df: sorted((str(x.d1), str(x.d2), x.row, x.col, round(x.z_re, 9), round(x.z_im, 9), round(x.p1, 9)) for x in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/store/pairs")) == key(B.accumulate(spark.createDataFrame(rows, schema), 2, 3))


def test_unsettled_loops_are_errors(spark):
    a = np.full((4, 40), np.nan)
    a[:, 0] = 1.0
    grid = grid_df(spark, a).drop("grid_id")
    assert P.grow(grid).where("v is null").count() == 0
    with pytest.raises(RuntimeError, match="settled"):
        P.grow(grid, rounds=3)
    with pytest.raises(RuntimeError, match="settled"):
        P.label_components(grid.select("row", "col"), 40, rounds=1)


def test_relaxation_solves_the_laplace_equation(spark, tmp_path):
    y, x = np.indices(X.LAT_SHAPE)
    field, hole = 0.05 * y + np.sin(x / 7.0), np.zeros(X.LAT_SHAPE, bool)
    hole[40:45, 30:36] = hole[80:83, 55:58] = True
    hole_tables(spark, tmp_path, field, hole)
    df = plans.QUERIES["m09_jacobi_fill"](spark, str(tmp_path)).toPandas()
    got = np.full(X.LAT_SHAPE, np.inf)
    got[df["i"], df["j"]] = df["v"]
    want = np.where(hole, 0.0, field)
    for _ in range(2000):
        mean = (want[:-2, 1:-1] + want[2:, 1:-1] + want[1:-1, :-2] + want[1:-1, 2:]) / 4
        want[1:-1, 1:-1] = np.where(hole[1:-1, 1:-1], mean, want[1:-1, 1:-1])
    assert np.abs(got - want).max() < 1e-3


def test_streamed_accumulation_equals_the_batch(spark, tmp_path):
    rows = [("A", f"2020010{d}", r, c, float(d * r - c), float(r + c * d)) for d in range(1, 5) for r in range(6) for c in range(6)]
    schema = "freq string, d string, row int, col int, re double, im double"
    df = spark.createDataFrame(rows, schema)
    for d in range(1, 5):
        df.where(F.col("d") == f"2020010{d}").coalesce(1).write.parquet(f"{tmp_path}/in/{d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    accumulate_stream(stream, f"{tmp_path}/store", 2, 3, f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/store/pairs").select("d1", "d2", "row", "col", F.round("z_re", 6).alias("z"), F.round("n", 6).alias("n"))
    want = B.accumulate(df, 2, 3).select("d1", "d2", "row", "col", F.round("z_re", 6).alias("z"), F.round("n", 6).alias("n"))
    key = lambda x: sorted((str(r.d1), str(r.d2), r.row, r.col, r.z, r.n) for r in x.collect())
    assert key(got) == key(want)


def test_a_batch_touches_its_dates_and_their_partners_only(spark, tmp_path):
    schema = "freq string, d string, row int, col int, re double, im double"
    r = np.random.default_rng(9)
    rows = [("A", d, i, j, *([None, 0.5] if (i, j) == (1, 2) else r.normal(size=2).tolist())) for d in "abcd" for i in range(4) for j in range(5)]
    frame = lambda dates: spark.createDataFrame([x for x in rows if x[1] in dates], schema)
    power = B.block_power(frame("abcd"), 2, 2)
    part = B.accumulate_new(frame("bd"), frame("abcd"), power, 2, 2)
    key = lambda df: sorted((x.d1, x.d2, x.row, x.col, *(round(v, 9) for v in (x.z_re, x.z_im, x.p1, x.p2, x.n))) for x in df.collect())
    whole = B.accumulate(frame("abcd"), 2, 2)
    assert key(part) == key(whole.where("d1 in ('b', 'd') or d2 in ('b', 'd')")) and part.where("d1 = 'a' and d2 = 'c'").count() == 0
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store = f"{tmp_path}/store"
    for k, dates in enumerate(["ab", "c", "d"]):
        # the stream stops after every batch and goes on
        frame(dates).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        old = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "store").glob("p*/**/*.parquet"))}
        accumulate_stream(stream(), store, 2, 2, f"{tmp_path}/ck").awaitTermination()
        assert all(os.stat(p).st_mtime_ns == t for p, t in old.items())
    assert key(spark.read.parquet(f"{store}/pairs")) == key(whole)


def test_exact_selection_by_passes(spark, monkeypatch):
    from tessera.operators import selection as Q

    monkeypatch.setattr(Q, "FEW_ROWS", 3)
    monkeypatch.setattr(Q, "BUCKETS", 8)
    r = np.random.default_rng(1)
    samples = [r.normal(size=501), np.repeat([1.0, 2.0, 7.0], [200, 1, 99]), r.lognormal(0, 8, 300), np.array([5.0]), np.array([-1e308, 0.0, 1e308, 3.0]), np.round(r.normal(size=400), 1)]
    for a in samples:
        df = spark.createDataFrame([(float(x),) for x in a] + [(None,)], "v double")
        ranks = sorted({0, len(a) // 3, len(a) // 2, len(a) - 1})
        assert Q.order_statistics(df, "v", ranks) == np.sort(a)[ranks].tolist()
        got = Q.percentiles(df, "v", (0.0, 0.25, 0.5, 0.99))
        want = df.agg(*[F.percentile("v", p) for p in (0.0, 0.25, 0.5, 0.99)]).first()
        assert got == list(want) and Q.median(df, "v") == want[2]
    assert Q.median(df.limit(0), "v") is None
    with pytest.raises(ValueError, match="ranks"):
        Q.order_statistics(df, "v", [400])


def test_entry_works_without_the_text_operators(tmp_path):
    """In a copy without them, and a fault inside them isn't taken for their absence."""
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    home = os.path.dirname(entry.__file__)
    shutil.copytree(f"{home}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", tmp_path)
    told = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert told().stdout.split() == [str(len(plans.QUERIES)), str(len(plans.ORACLE_SQL))]
    (tmp_path / "tessera/llm").mkdir()
    (tmp_path / "tessera/llm/__init__.py").write_text("import a_library_that_is_not_here")
    (tmp_path / "corpus_pipeline.py").write_text("import tessera.llm")
    assert "a_library_that_is_not_here" in told().stderr


def test_commands(spark, tmp_path, capsys):
    from tessera.cli import main

    rows = [("A", f"2020010{d}", r, c, float(np.cos(d * r)), float(np.sin(d * c))) for d in range(1, 4) for r in range(32) for c in range(32)]
    spark.createDataFrame(rows, "freq string, d string, row int, col int, re double, im double").write.parquet(f"{tmp_path}/samples")
    assert main(["stack", f"{tmp_path}/samples", f"{tmp_path}/acc", "--looks", "2,2"]) == 0
    assert main(["streak-index", f"{tmp_path}/acc", f"{tmp_path}/index", "--least", "16", "--min-stack-coh", "0.00001"]) == 0
    assert main(["select-pair", f"{tmp_path}/index", "--top", "2"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    assert main(["refocus"]) == 0 and main(["download"]) == 2


def test_touched_cells_against_brute_force(spark):
    from tessera.sources.grids import Grid, touched_cells

    g = Grid(100.0, 60.0, 2.0, 20, 15, 32606)
    ring = [(105.3, 55.1), (128.7, 48.2), (119.0, 35.6), (109.9, 44.0)]
    poly = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "id int, ring array<struct<x: double, y: double>>")
    for buffer in (0.0, 1.5):
        want = set()
        for r in range(15):
            for c in range(20):
                x0, x1, y1, y0 = 100 + 2 * c - buffer, 102 + 2 * c + buffer, 60 - 2 * r + buffer, 58 - 2 * r - buffer
                cx, cy = 101 + 2 * c, 59 - 2 * r
                inside = False
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                    inside ^= (ay > cy) != (by > cy) and cx < (bx - ax) * (cy - ay) / (by - ay) + ax
                    t = np.linspace(0, 1, 4001)
                    px, py = ax + t * (bx - ax), ay + t * (by - ay)
                    if ((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)).any():
                        want.add((r, c))
                if inside:
                    want.add((r, c))
        assert {(x["row"], x["col"]) for x in touched_cells(poly, g, buffer).collect()} == want


def test_grids_nest_and_refuse(spark):
    from tessera.sources.grids import Grid, cyclic_colours, grid_of, projected, resampled

    g = grid_of((0.0, 80.0, 0.0, 800.0, 0.0, -80.0), 10, 10, 32606)
    assert g.finer(20.0) == Grid(0.0, 800.0, 20.0, 40, 40, 32606)
    for bad in ((0.0, 80.0, 1.0, 0.0, 0.0, -80.0), (0.0, 80.0, 0.0, 0.0, 0.0, -40.0)):
        with pytest.raises(ValueError, match="grid|cells"):
            grid_of(bad, 1, 1, 32606)
    with pytest.raises(ValueError, match="divide"):
        g.finer(30.0)
    field = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    pts = spark.createDataFrame([(0, 0, 120.0, 680.0), (0, 1, 160.0, 600.0), (0, 2, 900.0, 10.0)], "row int, col int, x double, y double")
    # the second point lies halfway between the centres of cells 21 and 22
    assert {(r["col"], r["v"]) for r in resampled(pts, field, g).collect()} == {(0, 11.0), (1, 21.5), (2, None)}
    assert {(r["col"], r["v"]) for r in resampled(pts, field, g, 0).collect()} == {(0, 11.0), (1, 22.0), (2, None)}
    p = projected(spark.createDataFrame([(3.0, 0.0)], "lon double, lat double"), 31).first()
    assert abs(p["x"] - 500000) < 1e-6 and abs(p["y"]) < 1e-6
    assert cyclic_colours().shape == (256, 3)


def hole_tables(spark, path, field, hole):
    """A lineitem table whose lattice has the field as azimuth and low snr in the holes."""
    rows = [(r, c, float((field[r, c] - 3 * np.sin(r / 12)) / 20 + 0.05), 0.04, 9.0 if hole[r, c] else 30.0) for r, c in np.ndindex(X.LAT_SHAPE)]
    # lattice cells are remainders by 96 and 64, so keys below these are rows and columns
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_discount double, l_tax double, l_quantity double").write.parquet(f"{path}/lineitem.parquet")


def test_hole_queries_read_the_whole_lattice(spark, tmp_path):
    y, x = np.indices(X.LAT_SHAPE)
    plane, hole = 0.02 * y - 0.03 * x, np.zeros(X.LAT_SHAPE, bool)
    hole[60:66, 50:55] = hole[45:52, 10:13] = hole[92:96, 20:24] = True
    hole_tables(spark, tmp_path, plane, hole)
    known = np.where(hole, np.nan, plane)

    def got(name, column):
        df = plans.QUERIES[name](spark, str(tmp_path)).toPandas()
        out = np.full(X.LAT_SHAPE, np.inf)
        out[df["i"], df["j"]] = df[column]
        return out

    inside = got("r02_fill_interior", "v")
    want = K.local_fill(known)
    want[92:96, 20:24] = np.nan
    assert np.allclose(inside, want, atol=1e-5, equal_nan=True)
    assert np.allclose(got("w16_grow_medians", "v"), K.local_fill(known, True), atol=1e-5)
    assert np.allclose(got("m13_robust_plane", "filled"), plane, atol=1e-4)
    level = np.full(X.LAT_SHAPE, np.nanmean(known))
    for size in (128, 64, 32, 16, 8, 4, 2, 1):
        for r in range(0, 96, size):
            for c in range(0, 64, size):
                part = known[r : r + size, c : c + size]
                n = np.isfinite(part).sum()
                w = min(1, n / size**2 / 0.02)
                if n:
                    level[r : r + size, c : c + size] = w * np.nanmean(part) + (1 - w) * level[r : r + size, c : c + size]
    assert np.allclose(got("r08_regional_level", "level"), level, atol=1e-5)


def test_idw_reaches_over_the_whole_grid():
    a = np.full((10, 200), np.nan)
    a[3, 2] = 5.0
    assert np.allclose(K.idw_fill(a), 5.0, atol=1e-12)
    a[3, 199] = 1.0
    assert abs(K.idw_fill(a)[3, 12] - (5 / 10 + 1 / 187) / (1 / 10 + 1 / 187)) < 1e-12
    assert np.isnan(K.idw_fill(a, 0, 64)[3, 100])


def test_deep_holes_are_filled_in_full(spark, tmp_path):
    y, x = np.indices(X.LAT_SHAPE)
    field, hole = np.sin(y / 3.0) * np.cos(x / 4.0), np.zeros(X.LAT_SHAPE, bool)
    hole[60:80, 20:40] = True
    hole_tables(spark, tmp_path, field, hole)
    known = np.where(hole, np.nan, field)
    for name, column, want in (("w16_grow_medians", "v", K.local_fill(known, True)), ("m14_rbf_fill", "v", K.fill(known, "rbf", near=64))):
        df = plans.QUERIES[name](spark, str(tmp_path)).toPandas()
        cells = [c for c in ("i", "j", "row", "col") if c in df]
        got = np.full(X.LAT_SHAPE, np.inf)
        got[df[cells[0]], df[cells[1]]] = df[column]
        assert np.allclose(got, want, atol=1e-3)
