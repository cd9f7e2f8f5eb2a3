"""Command line: stack, streak-index, select-pair, grid, glacier-mask, check, coregister, interferogram, screen, refocus and run.

Inputs and outputs are Parquet tables with the schemas of tessera.schema; `interferogram` reads granules. Network fetches (scenes, elevation, land
cover) aren't part of this package; `download` and `dem` say so.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import joins as J
from tessera.operators import refocusing as C
from tessera.operators import resample as M
from tessera.operators import robust as R
from tessera.plans import routes as Z
from tessera.plans.products import Options, interferogram
from tessera.session import session
from tessera.sources import io as IO


def _pair(text: str) -> tuple[int, int]:
    a, b = text.split(",")
    return int(a), int(b)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flags, kw in options:
            p.add_argument(*flags, **kw)

    src, dst = (("source",), {}), (("out",), {})
    shape = (("--shape",), {"type": _pair, "required": True})
    add("download", (("rest",), {"nargs": "*"}))
    add("dem", (("rest",), {"nargs": "*"}))
    add("stack", src, dst, (("--looks",), {"type": _pair, "default": (48, 48)}))
    add("streak-index", src, dst, (("--smooth",), {"type": float, "default": 0.0}), (("--azimuth",), {"type": float, "default": 0.0}), (("--min-stack-coh",), {"type": float, "default": 0.15}), (("--loo",), {"action": "store_true"}), (("--least",), {"type": int, "default": 4096}))
    add("select-pair", src, (("--freq",), {"default": "A"}), (("--top",), {"type": int, "default": 5}))
    add("grid", src, dst, (("--posting",), {"type": float, "default": 80.0}), (("--pad",), {"type": float, "default": 10000.0}))
    add("glacier-mask", (("points",), {}), (("polygons",), {}), dst, (("--tile",), {"type": float, "default": 10000.0}))
    add("check", (("config",), {}), (("inputs",), {"nargs": "*"}))
    add("coregister", (("ref",), {}), (("sec",), {}), dst, shape, (("--window",), {"type": int, "default": 64}), (("--search",), {"type": int, "default": 64}), (("--skip",), {"type": int, "default": 16}), (("--snr",), {"type": float, "default": 8.0}), (("--apply",), {"action": "store_true"}))
    add("interferogram", (("ref",), {}), (("sec",), {}), dst, (("--freq",), {"default": "A"}), (("--pol",), {"default": "HH"}), (("--looks",), {"type": _pair, "default": (24, 16)}), (("--skip",), {"type": _pair, "default": (64, 64)}), (("--height",), {"type": float, "default": 0.0}), (("--carrier",), {"type": float, "default": 0.0}), (("--alpha",), {"type": float, "default": 0.5}), (("--nfft",), {"type": int, "default": 32}), (("--cells",), {}))
    add("screen", (("--routes",), {"default": "hybrid"}), (("--lattice",), {}), (("--bands",), {}), dst, shape, (("--f0",), {"type": float, "default": 1239.0}), (("--f1",), {"type": float, "default": 1293.5}), (("--cut-km",), {"type": float, "default": 20.0}), (("--row-m",), {"type": float, "default": 71.0}), (("--col-m",), {"type": float, "default": 120.0}), (("--az-spacing",), {"type": float, "default": 4.44}), (("--wavelength",), {"type": float, "default": 0.242}), (("--slant0",), {"type": float, "default": 8e5}))
    floats = lambda **defaults: [((f"--{k.replace('_', '-')}",), {"type": float, "default": v}) for k, v in defaults.items()]
    ints = lambda **defaults: [((f"--{k.replace('_', '-')}",), {"type": int, "default": v}) for k, v in defaults.items()]
    add("refocus", *[((name,), {"nargs": "?"}) for name in ("pair", "field", "out")], (("--shape",), {"type": _pair}), (("--origin",), {"type": _pair, "default": (96, 96)}), (("--skip",), {"type": _pair, "default": (16, 16)}), (("--looks",), {"type": _pair, "default": (24, 16)}), *floats(prf=1520.0, bandwidth=1262.5, centre=0.0, spacing=4.44, along_km=None, least_gain=0.01), *ints(block=240, hop=120, samples=2048, picks=24))
    add("run", (("config",), {}), (("ref",), {}), (("sec",), {}), (("bands",), {}), dst, shape)
    return top


def _coregister(spark, a) -> None:
    amp = lambda p: spark.read.parquet(p).select("row", "col", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("v"))
    found = Z.match_windows(amp(a.ref), amp(a.sec), a.window, a.search, a.skip, a.shape)
    found.write.mode("overwrite").parquet(f"{a.out}/offsets")
    clean = Z.clean_lattice(spark.read.parquet(f"{a.out}/offsets"), (a.search, a.search), a.snr)
    Z.fill_channels(clean).write.mode("overwrite").parquet(f"{a.out}/lattice")
    if a.apply:
        # nodes stand at the centres of their windows
        nodes = spark.read.parquet(f"{a.out}/lattice")
        origin = float(a.search + a.window // 2)
        lattice = M.Lattice((origin, origin), (float(a.skip), float(a.skip)), tuple(max((n - a.window - 2 * a.search) // a.skip, 1) for n in a.shape))
        offsets = nodes.select("row", "col", F.col("azimuth").alias("az"), F.col("range").alias("rg"))
        M.resampled_image(spark.read.parquet(a.sec), offsets, lattice, a.shape).write.mode("overwrite").parquet(f"{a.out}/resampled")


def _interferogram(spark, a) -> None:
    """Makes or reuses the stages below out and tells which; with --cells (lon, lat, height) a map too."""
    options = Options(a.freq, a.pol, a.skip, a.carrier, a.height, a.looks, a.alpha, a.nfft)
    _, log = interferogram(spark, a.ref, a.sec, a.out, options, cells=spark.read.parquet(a.cells) if a.cells else None)
    for name, digest, reused in log:
        print(f"{name}-{digest} {'reused' if reused else 'made'}")


def _refocus(spark, a) -> None:
    """Refocuses the second image of a pair by a field, if that pays, and tells what was found."""
    if not (a.field and a.out and a.shape):
        raise SystemExit("refocus needs a pair, a field, an output and --shape; without any it runs its self-test")
    field = spark.read.parquet(a.field)
    last = field.agg(F.max("row"), F.max("col")).first()
    lattice = M.Lattice(tuple(map(float, a.origin)), tuple(map(float, a.skip)), (last[0] + 1, last[1] + 1))
    image, told = C.refocus(spark.read.parquet(a.pair), field, lattice, a.shape, C.Band(a.prf, a.bandwidth, a.centre, a.spacing), a.along_km, a.block, a.hop, a.samples, a.least_gain, picks=a.picks, looks=a.looks)
    image.write.mode("overwrite").parquet(a.out)
    print(" ".join(f"{k}={v}" for k, v in told.items()))


def _screen(spark, a) -> None:
    routes = list(dict.fromkeys(a.routes.split(",")))
    unknown = [r for r in routes if r not in Z.ROUTES]
    if unknown:
        raise SystemExit(f"unknown routes: {', '.join(unknown)}")
    made = {}
    if {"offsets", "hybrid"} & set(routes):
        meta = {"az_spacing": a.az_spacing, "wavelength": a.wavelength, "slant0": a.slant0, "dslant": a.col_m, "da": a.row_m, "dr": a.col_m}
        made["offsets"] = Z.offsets_screen(spark.read.parquet(a.lattice), a.shape, meta)
    if {"split", "hybrid"} & set(routes):
        made["split"] = Z.split_screen(spark.read.parquet(a.bands), a.f0, a.f1, a.shape)
    for name in made:
        made[name].write.mode("overwrite").parquet(f"{a.out}/{name}")
        made[name] = spark.read.parquet(f"{a.out}/{name}")
    if "hybrid" in routes:
        Z.hybrid_screen(made["split"], made["offsets"], a.shape, a.cut_km, a.row_m).write.mode("overwrite").parquet(f"{a.out}/hybrid")


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if a.command in ("download", "dem"):
        print(f"{a.command}: fetching isn't part of this package; give the tables to the other commands", file=sys.stderr)
        return 2
    if a.command == "refocus" and a.pair is None:
        for name, value in Z.refocus_self_test().items():
            print(f"{name} {value:.6f}")
        return 0
    spark = session()
    if a.command == "stack":
        B.accumulate(spark.read.parquet(a.source), *a.looks).write.mode("overwrite").partitionBy("freq", "d1", "d2").parquet(a.out)
    elif a.command == "streak-index":
        coh = B.coherence(spark.read.option("basePath", a.source).parquet(a.source).withColumn("d1", F.col("d1").cast("string")).withColumn("d2", F.col("d2").cast("string")))
        IO.write_index(Z.streak_index(coh, a.smooth, a.azimuth, a.least, min_coh=a.min_stack_coh, loo=a.loo), a.out)
    elif a.command == "select-pair":
        rows = R.rank_pairs(IO.read_index(spark, a.source), a.freq, a.top).orderBy("rank").collect()
        if not rows:
            raise SystemExit(f"no rows of frequency {a.freq}")
        for r in rows:
            print(f"{r['rank']} {r['d1']} {r['d2']} R={r['R_fft']} {r['direction']}{' weak' if r['weak'] else ''}")
    elif a.command == "grid":
        IO.snapped_grid(spark.read.parquet(a.source), a.posting, a.posting, a.pad).write.mode("overwrite").parquet(a.out)
    elif a.command == "glacier-mask":
        points = spark.read.parquet(a.points)
        J.points_in_polygons(points, spark.read.parquet(a.polygons), ["row", "col"], a.tile).select("row", "col").distinct().write.mode("overwrite").parquet(a.out)
    elif a.command == "check":
        IO.read_config(a.config)
        problems = []
        for path in a.inputs:
            try:
                spark.read.parquet(path).schema  # noqa: B018
            except Exception as e:  # every problem is listed, none stops the list
                problems.append(f"{path}: {str(e).splitlines()[0]}")
        print("\n".join(problems) or "ready")
        return int(bool(problems))
    elif a.command == "coregister":
        _coregister(spark, a)
    elif a.command == "interferogram":
        _interferogram(spark, a)
    elif a.command == "refocus":
        _refocus(spark, a)
    elif a.command == "screen":
        _screen(spark, a)
    elif a.command == "run":
        config = IO.read_config(a.config)
        shape = f"{a.shape[0]},{a.shape[1]}"
        main(["coregister", a.ref, a.sec, a.out, "--shape", shape, "--window", "16", "--search", "4", "--skip", "16"])
        nodes = [max((n - 16 - 8) // 16, 0) for n in a.shape]
        main(["screen", "--routes", "hybrid", "--lattice", f"{a.out}/lattice", "--bands", a.bands, a.out, "--shape", f"{nodes[0]},{nodes[1]}", "--cut-km", str(config.hybrid_cut_km)])
    return 0


if __name__ == "__main__":
    sys.exit(main())
