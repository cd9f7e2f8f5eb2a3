"""Readers and writers of rasters, products, tables, shapes and settings.

Rasters live in Parquet by (grid_id, row, col) or as tiles; files of array libraries (npz, raw binaries, headers) are
read and written on the driver or in tasks, one file a task, and become tables at once.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.kernels import to_long
from tessera.schema import RASTER


# ---- raster tables -------------------------------------------------------------------------------------------------
def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """A raster table, cut to half-open row and column windows; both are pushed down to the scan."""
    df = spark.read.parquet(path)
    for name, span in (("row", rows), ("col", cols)):
        if span:
            df = df.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    return df


def write_raster(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """Parquet by grid with rows in order, so that row windows prune row groups; meta goes beside it as one row."""
    df.repartition("grid_id").sortWithinPartitions("grid_id", "row", "col").write.mode("overwrite").partitionBy("grid_id").parquet(path)
    if meta is not None:
        df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path.rstrip('/')}.meta")


def tiles(df: DataFrame, size: int) -> DataFrame:
    """(grid_id, ty, tx, h, w, data) tiles of size x size, row-major with NULL where missing, from a raster table."""
    ty, tx = F.expr(f"row div {size}").cast("int"), F.expr(f"col div {size}").cast("int")
    cell = F.struct(((F.col("row") % size) * size + F.col("col") % size).alias("k"), "v")
    g = df.groupBy("grid_id", ty.alias("ty"), tx.alias("tx")).agg(F.map_from_entries(F.collect_list(cell)).alias("m"), (F.max(F.col("row") % size) + 1).cast("int").alias("h"), (F.max(F.col("col") % size) + 1).cast("int").alias("w"))
    return g.select("grid_id", "ty", "tx", "h", "w", F.expr(f"transform(sequence(0, h * w - 1), k -> m[cast(k div w * {size} + k % w as int)])").alias("data"))


def untiled(df: DataFrame, size: int) -> DataFrame:
    """The raster table of tiles."""
    e = df.select("grid_id", "ty", "tx", "w", F.posexplode("data").alias("k", "v"))
    return e.select("grid_id", F.expr(f"cast(ty * {size} + k div w as int)").alias("row"), F.expr(f"cast(tx * {size} + k % w as int)").alias("col"), "v")


def decimated(df: DataFrame, most: int, rows: int, cols: int, cyclic: bool) -> DataFrame:
    """A quick look of at most `most` cells a side: nearest cells of cyclic phase, means of other values."""
    step = max(1, -(-max(rows, cols) // most))
    if cyclic:
        return df.where((F.col("row") % step == step // 2) & (F.col("col") % step == step // 2)).withColumn("row", F.expr(f"cast(row div {step} as int)")).withColumn("col", F.expr(f"cast(col div {step} as int)"))
    return df.groupBy("grid_id", F.expr(f"cast(row div {step} as int)").alias("row"), F.expr(f"cast(col div {step} as int)").alias("col")).agg(F.avg("v").alias("v"))


def look_centres(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """The cell at the centre of each look box."""
    inside = df.where((F.col("row") % rows == rows // 2) & (F.col("col") % cols == cols // 2))
    return inside.withColumn("row", F.expr(f"cast(row div {rows} as int)")).withColumn("col", F.expr(f"cast(col div {cols} as int)"))


def add_in_place(df: DataFrame, shift: DataFrame, nodata_below: float = -1e5) -> DataFrame:
    """A new version of a raster with a shift (row, col, d) added where it holds data; cells without a shift stay."""
    out = df.join(shift.select("row", "col", "d"), ["row", "col"], "left")
    return out.withColumn("v", F.when(F.col("v") > nodata_below, F.col("v") + F.coalesce("d", F.lit(0.0))).otherwise(F.col("v"))).drop("d")


def masked(df: DataFrame, mask: DataFrame) -> DataFrame:
    """df with v missing in the cells of the mask (row, col)."""
    m = mask.select("row", "col").distinct().withColumn("m_", F.lit(True))
    return df.join(m, ["row", "col"], "left").withColumn("v", F.when(F.col("m_").isNull(), F.col("v"))).drop("m_")


# ---- array files ---------------------------------------------------------------------------------------------------
def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """RASTER rows of every two-dimensional array of npz files, grid_id being file#key; non-finite values are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    for key in found.files:
                        a = found[key]
                        if a.ndim == 2 and a.dtype.kind in "fiub":
                            yield to_long(a.astype(float), grid_id=f"{name.rsplit('/', 1)[-1]}#{key}")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RASTER)


def read_npz_scalars(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of the scalars and short vectors of npz files, a vector as key[k]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    for key in found.files:
                        a = found[key]
                        if a.ndim < 2 and a.dtype.kind in "fiub" and a.size <= 16:
                            rows += [(name, key if a.ndim == 0 else f"{key}[{k}]", float(v)) for k, v in enumerate(a.ravel())]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, value double")


def write_npz(path: str, **arrays) -> None:
    """Writes an npz whole or not at all."""
    part = Path(f"{path}.part")
    with part.open("wb") as out:
        np.savez_compressed(out, **arrays)
    part.replace(path)


def read_flat(spark: SparkSession, path: str, shape: tuple[int, int], dtype: str, block_rows: int = 256, rows: tuple[int, int] | None = None) -> DataFrame:
    """RASTER rows of a headerless row-major binary, by blocks of rows; complex values give v (real) in grid re and im.

    Every task seeks to its own rows, so a file of any size is read in parallel, and of a half-open window only its rows.
    """
    item = np.dtype(dtype)
    low, high = rows or (0, shape[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for first in batch["id"]:
                n = min(block_rows, high - first)
                with files.open_input_file(root) as f:
                    f.seek(int(first) * shape[1] * item.itemsize)
                    a = np.frombuffer(f.read(n * shape[1] * item.itemsize), item).reshape(n, shape[1])
                parts = {"re": a.real, "im": a.imag} if item.kind == "c" else {"v": a}
                for grid, values in parts.items():
                    out = to_long(values.astype(float), grid_id=grid)
                    out["row"] += np.int32(first)
                    yield out

    blocks = spark.range(low, high, block_rows)
    return blocks.repartition(max(1, min(-(-(high - low) // block_rows), 1024))).mapInPandas(run, RASTER)


def header_shape(text: str) -> tuple[int, int]:
    """(rows, cols) of an XML raster header."""
    x, y = re.search(r'rasterXSize="(\d+)"', text), re.search(r'rasterYSize="(\d+)"', text)
    if not x or not y:
        raise ValueError("no raster size in the header")
    return int(y[1]), int(x[1])


def header_text(name: str, shape: tuple[int, int], dtype: str) -> str:
    kinds = {"complex64": "CFloat32", "float32": "Float32", "float64": "Float64", "uint8": "Byte"}
    size = np.dtype(dtype).itemsize
    return f'<VRTDataset rasterXSize="{shape[1]}" rasterYSize="{shape[0]}"><VRTRasterBand dataType="{kinds[dtype]}" band="1" subClass="VRTRawRasterBand"><SourceFilename relativeToVRT="1">{name}</SourceFilename><ByteOrder>LSB</ByteOrder><ImageOffset>0</ImageOffset><PixelOffset>{size}</PixelOffset><LineOffset>{size * shape[1]}</LineOffset></VRTRasterBand></VRTDataset>'


# ---- tables --------------------------------------------------------------------------------------------------------
def write_index(df: DataFrame, path: str) -> None:
    """One ordered result table as CSV with a header; it has one row for each pair, so one file is enough."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("freq string, d1 string, d2 string, R_fft double, theta_fft double, D_RA double, coh_mean double, n_cells bigint").csv(path)


def files_by_date(names: DataFrame, dates: DataFrame) -> DataFrame:
    """(d, path): the first path in order for each wanted date; a wanted date without one raises an error."""
    d = F.regexp_extract("path", r"(\d{8})", 1)
    first = names.where(d != "").groupBy(d.alias("d")).agg(F.min("path").alias("path"))
    found = dates.select("d").distinct().join(first, "d", "left")
    return found.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no file for "), F.col("d"))).cast("string")))


def fallback(columns: list[Column], default) -> Column:
    """The first value that is there: measured, then from a file, then the default."""
    return F.coalesce(*columns, F.lit(default))


def wkt_points(text: Column) -> Column:
    """The x y pairs of a WKT polygon as an array of structs; extra ordinates are left out, fewer than 3 points are null."""
    inner = F.regexp_extract(text, r"\(\(([^)]*)\)", 1)
    pts = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
    return F.when(F.size(F.split(inner, ",")) >= 3, pts)


def cover_tiles(x0: Column, y0: Column, x1: Column, y1: Column, size: int = 3) -> Column:
    """Names of all tiles of `size` degrees that a box meets, from their lower left corners."""
    low = lambda c: (F.floor(c / size) * size).cast("int")
    name = lambda la, lo: F.concat(F.when(la >= 0, "N").otherwise("S"), F.lpad(F.abs(la).cast("string"), 2, "0"), F.when(lo >= 0, "E").otherwise("W"), F.lpad(F.abs(lo).cast("string"), 3, "0"))
    lats, lons = F.sequence(low(y0), low(y1), F.lit(size)), F.sequence(low(x0), low(x1), F.lit(size))
    return F.flatten(F.transform(lats, lambda la: F.transform(lons, lambda lo: name(la, lo))))


def snapped_grid(ring: DataFrame, dx: float, dy: float, pad: float) -> DataFrame:
    """One row (x0, y0, nx, ny): the box of ring (x, y), padded and snapped outwards to the posting."""
    b = ring.agg(*[f(c).alias(n) for n, f, c in (("a", F.min, "x"), ("b", F.max, "x"), ("c", F.min, "y"), ("d", F.max, "y"))])
    b = b.select((F.floor((F.col("a") - pad) / dx) * dx).alias("x0"), (F.ceil((F.col("d") + pad) / dy) * dy).alias("y0"), (F.ceil((F.col("b") + pad) / dx) * dx).alias("x1"), (F.floor((F.col("c") - pad) / dy) * dy).alias("y1"))
    return b.select("x0", "y0", F.rint((F.col("x1") - F.col("x0")) / dx).cast("int").alias("nx"), F.rint((F.col("y0") - F.col("y1")) / dy).cast("int").alias("ny"))


def setting_differences(a: DataFrame, b: DataFrame, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """(key, have, want) of the settings (key, value) that differ; a missing shell height counts as 0, other missing
    ones are unknown and listed with null."""
    j = a.select("key", F.col("value").alias("have")).join(b.select("key", F.col("value").alias("want")), "key", "full")
    have = F.when(F.col("key") == "iono_shell_km", F.coalesce("have", F.lit(0.0))).otherwise(F.col("have"))
    j = j.withColumn("have", have)
    same = F.abs(F.col("have") - F.col("want")) <= atol + rtol * F.abs("want")
    return j.where(~F.coalesce(same, F.lit(False)))


# ---- settings ------------------------------------------------------------------------------------------------------
@dataclass
class PairConfig:
    """Settings of one pair; unset names of products derive from track, frame and dates. Keys and defaults are fixed values."""

    track: int
    frame: int
    dates: list[str]
    pol: str = "HH"
    grid_epsg: int = 3413
    posting: float = 120.0
    looks: tuple[int, int] = (24, 16)
    gpus: str = "0"
    cache: str = "cache"
    coreg_out: str = "outputs_offsets"
    routes_out: str = "outputs_unified"
    refocus_km: str = "auto"
    hybrid_cut_km: float = 32.0
    fill: dict = field(default_factory=dict)
    outlier: dict = field(default_factory=dict)
    split: dict = field(default_factory=dict)
    tag: str = ""
    scratch: str = ""
    dem: str = ""
    grid: str = ""
    glacier_mask: str = ""
    ref: str = ""
    sec: str = ""

    def __post_init__(self) -> None:
        self.track, self.frame, self.grid_epsg = int(self.track), int(self.frame), int(self.grid_epsg)
        self.dates = [str(d).replace("-", "") for d in self.dates]
        self.posting, self.hybrid_cut_km = float(self.posting), float(self.hybrid_cut_km)
        self.looks = (int(self.looks[0]), int(self.looks[1]))
        self.gpus, self.refocus_km = str(self.gpus), str(self.refocus_km)
        track, frame, pair = f"t{self.track:03d}", f"f{self.frame:03d}", "_".join(self.dates)
        self.tag = self.tag or f"{track}_{pair}"
        self.scratch = self.scratch or f"offsets_scratch_{pair}"
        self.dem = self.dem or f"{self.cache}/dem_insar_{track}.tif"
        self.grid = self.grid or f"{self.cache}/grid_{track}_{frame}_{self.posting:.0f}m_{self.grid_epsg}.tif"
        self.glacier_mask = self.glacier_mask or f"{self.cache}/rgi_glacier_{track}_ifggrid.tif"

    @property
    def offsets(self) -> str:
        return f"{self.coreg_out}/offsets_{self.tag}.npz"

    @property
    def refocus(self) -> float | None:
        """Kilometres of the refocusing layer, or None where it is to be measured."""
        return None if self.refocus_km == "auto" else float(self.refocus_km)


def read_config(path: str) -> PairConfig:
    """The settings of a pair; unknown keys and missing track, frame or dates are errors."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    unknown = set(raw) - set(PairConfig.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    missing = [k for k in ("track", "frame", "dates") if k not in raw]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    if not isinstance(raw["dates"], list) or len(raw["dates"]) != 2:
        raise ValueError("a pair has two dates")
    return PairConfig(**raw)
