"""GeoTIFF files and mosaics of them: raster tables to tiled, deflated files and back.

Tasks write and read files, one part or tile at a time; no values pass through the driver. Files go through pyarrow's file
systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import RASTER
from tessera.sources.io import read_flat

BLOCK = 512
#: Lines and samples of a file of a mosaic.
PART = 2048
#: Bytes of raw values beyond which a file gets 64-bit offsets.
BIG = 2_000_000_000
# fixed values of the file format: field types by number, and sample formats
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("Q", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f", 6: "c"}


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


def _differences(a: np.ndarray) -> np.ndarray:
    """Predictor 2: every value less the one to its left, as integers of the same width."""
    u = np.ascontiguousarray(a).view(f"u{a.itemsize}")
    out = u.copy()
    out[:, 1:] -= u[:, :-1]
    return out


def _tile_bytes(a: np.ndarray, level: int) -> bytes:
    return zlib.compress((a if a.dtype.kind == "c" else _differences(a)).tobytes(), level)


def _directory(entries: list[tuple[int, int, list | bytes]], big: bool) -> bytes:
    """Header and first directory, with the values that don't fit an entry behind it."""
    head, count, word, inline = (16, "<Q", "Q", 8) if big else (8, "<H", "I", 4)
    entry = 20 if big else 12
    start = head + struct.calcsize(count) + entry * len(entries) + inline
    table, behind = b"", b""
    for tag, kind, values in entries:
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_TYPES[kind][0]}", *values)
        n = len(raw) // _TYPES[kind][1]
        if len(raw) > inline:
            where = struct.pack(f"<{word}", start + len(behind))
            behind += raw + b"\0" * (-len(raw) % 8)
            raw = where
        table += struct.pack(f"<HH{word}", tag, kind, n) + raw.ljust(inline, b"\0")
    first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    return first + struct.pack(count, len(entries)) + table + b"\0" * inline + behind


@dataclass(frozen=True)
class Layout:
    """What a file needs beside its values: block, compression level, transform, projection, nodata, and whether it's complex."""

    block: int
    level: int
    transform: tuple[float, ...]
    epsg: int
    nodata: float | None
    cplx: bool

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<c8" if self.cplx else "<f4")

    @property
    def blank(self) -> float:
        return np.nan if self.nodata is not None and not self.cplx else 0.0

    def shifted(self, row: int, col: int) -> Layout:
        x0, dx, _, y0, _, dy = self.transform
        return replace(self, transform=(x0 + col * dx, dx, 0.0, y0 + row * dy, 0.0, dy))

    def file(self, a: np.ndarray) -> bytes:
        """The file of a dense array; blank tiles share one."""
        (rows, cols), n = a.shape, self.block
        across, down = -(-cols // n), -(-rows // n)
        big = rows * cols * self.dtype.itemsize > BIG
        padded = np.full((down * n, across * n), self.blank, self.dtype)
        padded[:rows, :cols] = a
        empty = _tile_bytes(np.full((n, n), self.blank, self.dtype), self.level)
        tiles = [_tile_bytes(np.ascontiguousarray(padded[y * n : (y + 1) * n, x * n : (x + 1) * n]), self.level) for y in range(down) for x in range(across)]
        x0, dx, _, y0, _, dy = self.transform
        geographic = 4000 <= self.epsg < 5000
        keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, self.epsg]

        def header(offsets: list[int], counts: list[int]) -> bytes:
            wide = 16 if big else 4
            entries = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [self.dtype.itemsize * 8]), (259, 3, [8]), (262, 3, [1]), (277, 3, [1]), (317, 3, [1 if self.cplx else 2]), (322, 4, [n]), (323, 4, [n]), (324, wide, offsets), (325, wide, counts), (339, 3, [6 if self.cplx else 3]), (33550, 12, [dx, -dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (34735, 3, keys)]
            if self.nodata is not None and not self.cplx:
                entries.append((42113, 2, f"{self.nodata!r}".encode() + b"\0"))
            return _directory(entries, big)

        first = len(header([0] * len(tiles), [0] * len(tiles)))
        own, at = [], first + len(empty)
        for t in tiles:
            own.append(first if t == empty else at)
            at += 0 if t == empty else len(t)
        return b"".join([header(own, [len(t) for t in tiles]), empty, *[t for t in tiles if t != empty]])


def _put(path: str, data: bytes) -> None:
    """Writes beside the place and renames, so that a file is whole or not there, however often its task runs."""
    files, root = _files(path)
    folder = root.rsplit("/", 1)[0]
    files.create_dir(folder, recursive=True)
    beside = f"{folder}/.part-{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        out.write(data)
    files.move(beside, root)


def _written_parts(df: DataFrame, name: Callable[[int, int], str], shape: tuple[int, int], layout: Layout, part: int) -> list[tuple[int, int, int]]:
    """(row, col, bytes) of the files of a raster's parts, each written by the task that holds its cells as one group."""
    spark, (rows, cols) = df.sparkSession, shape
    values = ["re", "im"] if layout.cplx else ["v"]

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["pi"].iloc[0]), int(pdf["pj"].iloc[0])
        a = np.full((min(part, rows - i * part), min(part, cols - j * part)), layout.blank, layout.dtype)
        own = pdf[pdf["row"].notna()]
        r, c = own["row"].to_numpy(int) - i * part, own["col"].to_numpy(int) - j * part
        if layout.cplx:
            a[r, c] = np.nan_to_num(own["re"].to_numpy(float, na_value=np.nan)) + 1j * np.nan_to_num(own["im"].to_numpy(float, na_value=np.nan))
        else:
            v = own["v"].to_numpy(float, na_value=np.nan)
            a[r, c] = np.where(np.isnan(v), layout.blank, v)
        data = layout.shifted(i * part, j * part).file(a)
        _put(name(i, j), data)
        return pd.DataFrame({"pi": [i], "pj": [j], "n": [len(data)]})

    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    pi = F.when(inside, F.expr(f"row div {part}")).otherwise(F.raise_error(F.lit("a cell lies outside the grid")).cast("long")).cast("int")
    across = -(-cols // part)
    cells = df.select(pi.alias("pi"), F.expr(f"cast(col div {part} as int)").alias("pj"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(v).cast("double").alias(v) for v in values])
    # a row for each part, so that those without cells have a file too
    every = spark.range(across * -(-rows // part)).select(F.expr(f"cast(id div {across} as int)").alias("pi"), (F.col("id") % across).cast("int").alias("pj"))
    dealt = cells.unionByName(every, allowMissingColumns=True)
    # three numbers for each part of part * part cells
    return [(r.pi * part, r.pj * part, r.n) for r in dealt.groupBy("pi", "pj").applyInPandas(put, "pi int, pj int, n long").orderBy("pi", "pj").collect()]


def _layout(df: DataFrame, transform: tuple[float, ...], epsg: int, nodata: float | None, level: int, block: int) -> Layout:
    if transform[2] or transform[4]:
        raise ValueError("the grid is rotated")
    if not epsg:
        raise ValueError("the grid has no projection")
    return Layout(block, level, transform, epsg, nodata, "re" in df.columns)


def write_geotiff(df: DataFrame, path: str, shape: tuple[int, int], transform: tuple[float, ...], epsg: int, nodata: float | None = None, level: int = 6, block: int = BLOCK) -> int:
    """Writes one grid (row, col, v), or complex (row, col, re, im), as a tiled, deflated GeoTIFF of 32-bit floats.

    Missing cells are NaN if nodata is given and values are real, and 0 else. Cells outside the shape are an error; of a
    cell that comes twice any one is taken. The file is one group, which its task writes and renames into place; a grid
    of more than PART ** 2 cells is an error, as it is a mosaic's (write_mosaic). Returns the bytes written.
    """
    layout = _layout(df, transform, epsg, nodata, level, block)
    if shape[0] * shape[1] > PART**2:
        raise ValueError(f"{shape[0]} x {shape[1]} cells are too many for one file; write a mosaic")
    return _written_parts(df, lambda i, j: path, shape, layout, max(shape))[0][2]


def write_mosaic(df: DataFrame, path: str, shape: tuple[int, int], transform: tuple[float, ...], epsg: int, nodata: float | None = None, level: int = 6, block: int = BLOCK, part: int = PART) -> int:
    """Writes a grid as write_geotiff does, in parts of part * part cells, and a VRT header at `path` that joins them.

    Tasks write the parts, each a whole GeoTIFF in a folder beside the header, and rename them into place; the driver gets the
    length of each and writes the header last, so a mosaic is there with all its parts or not at all. A part
    without cells has a file too. Returns the bytes of the parts.
    """
    layout = _layout(df, transform, epsg, nodata, level, block)
    if part % block:
        raise ValueError("a part has to hold whole blocks")
    name = path.rsplit("/", 1)[-1].removesuffix(".vrt") + f"-{uuid.uuid4().hex[:12]}"
    folder = f"{path.rsplit('/', 1)[0]}/{name}"
    parts = _written_parts(df, lambda i, j: f"{folder}/{i}-{j}.tif", shape, layout, part)
    sources = "".join(f'<SimpleSource><SourceFilename relativeToVRT="1">{name}/{r // part}-{c // part}.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="{min(part, shape[1] - c)}" ySize="{min(part, shape[0] - r)}"/><DstRect xOff="{c}" yOff="{r}" xSize="{min(part, shape[1] - c)}" ySize="{min(part, shape[0] - r)}"/></SimpleSource>' for r, c, _ in parts)
    x0, dx, _, y0, _, dy = transform
    gone = "" if layout.cplx or nodata is None else f"<NoDataValue>{nodata!r}</NoDataValue>"
    _put(path, f'<VRTDataset rasterXSize="{shape[1]}" rasterYSize="{shape[0]}"><SRS>EPSG:{epsg}</SRS><GeoTransform>{x0!r}, {dx!r}, 0.0, {y0!r}, 0.0, {dy!r}</GeoTransform><VRTRasterBand dataType="{"CFloat32" if layout.cplx else "Float32"}" band="1">{gone}{sources}</VRTRasterBand></VRTDataset>'.encode())
    return sum(n for _, _, n in parts)


@dataclass(frozen=True)
class Tiff:
    """What the first directory of a file says; tiles are strips where these reach across the whole grid."""

    shape: tuple[int, int]
    dtype: str
    block: tuple[int, int]
    tiled: bool
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    compression: int
    predictor: int
    transform: tuple[float, ...] | None
    epsg: int | None
    nodata: float | None


def geotiff_header(path: str) -> Tiff:
    """The header of a single-band file; other layouts and compressions than plain and deflate are errors."""
    files, root = _files(path)
    with files.open_input_file(root) as f:
        first = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(first[:2])
        version = struct.unpack(f"{order}H", first[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} isn't a TIFF file")
        big = version == 43
        word, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
        f.seek(struct.unpack(f"{order}Q", first[8:16])[0] if big else struct.unpack(f"{order}I", first[4:8])[0])
        n = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
        table, tags = f.read(entry * n), {}
        for k in range(n):
            tag, kind, m = struct.unpack(f"{order}HH{word}", table[k * entry : (k + 1) * entry - inline])
            raw = table[(k + 1) * entry - inline : (k + 1) * entry]
            if kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            m *= 2 if kind == 5 else 1
            size = 4 if kind == 5 else size
            if size * m > inline:
                f.seek(struct.unpack(order + word, raw)[0])
                raw = f.read(size * m)
            tags[tag] = raw[:m].rstrip(b"\0").decode() if kind == 2 else struct.unpack(f"{order}{m}{'I' if kind == 5 else code}", raw[: size * m])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(277, 1) != 1:
        raise ValueError("the file has several bands")
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) not in (1, 2):
        raise ValueError(f"compression {one(259, 1)} with predictor {one(317, 1)} isn't known")
    cols, rows, tiled = one(256, 0), one(257, 0), 322 in tags
    dtype = f"{order}{_KINDS[one(339, 1)]}{one(258, 1) // 8}"
    scale, tie, keys = tags.get(33550), tags.get(33922), tags.get(34735, ())
    transform = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]) if scale and tie else None
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    block = (one(323, rows), one(322, cols)) if tiled else (min(one(278, rows), rows), cols)
    return Tiff((rows, cols), dtype, block, tiled, tags[324 if tiled else 273], tags[325 if tiled else 279], one(259, 1), one(317, 1), transform, named.get(3072, named.get(2048)), float(tags[42113]) if 42113 in tags else None)


def mosaic_header(path: str) -> tuple[tuple[int, int], tuple[float, ...], int | None, list[tuple[str, int, int]]]:
    """(shape, transform, projection, parts (path, row, col)) of a mosaic; other than whole parts side by side is an error."""
    files, root = _files(path)
    with files.open_input_stream(root) as f:
        top = ET.fromstring(f.read())
    parts = []
    for s in top.iter("SimpleSource"):
        name, src, dst = s.find("SourceFilename"), s.find("SrcRect"), s.find("DstRect")
        if src.get("xOff") != "0" or src.get("yOff") != "0" or (src.get("xSize"), src.get("ySize")) != (dst.get("xSize"), dst.get("ySize")):
            raise ValueError("a part of the mosaic is cut or scaled")
        parts.append((f"{path.rsplit('/', 1)[0]}/{name.text}" if name.get("relativeToVRT") == "1" else name.text, int(dst.get("yOff")), int(dst.get("xOff"))))
    code = top.findtext("SRS") or ""
    return (int(top.get("rasterYSize")), int(top.get("rasterXSize"))), tuple(float(x) for x in top.findtext("GeoTransform").split(",")), int(code[5:]) if code.startswith("EPSG:") else None, parts


def raster_shape(path: str) -> tuple[int, int]:
    return mosaic_header(path)[0] if path.endswith(".vrt") else geotiff_header(path).shape


def read_geotiff(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """RASTER rows of a file or of a mosaic (.vrt), cut to half-open windows; only tiles that meet these are read, in parallel.

    Nodata and non-finite values are null. Complex values give their parts as grids re and im, others the grid v. A task
    reads one tile at a time; the parts of a mosaic are opened by tasks only.
    """
    if path.endswith(".vrt"):
        shape, _, _, parts = mosaic_header(path)
    else:
        shape, parts = geotiff_header(path).shape, [(path, 0, 0)]
    (r0, r1), (c0, c1) = ((max(a, 0), min(b, n)) for (a, b), n in zip((rows or (0, shape[0]), cols or (0, shape[1])), shape, strict=True))

    def tiles_of(name: str, row: int, col: int) -> list[tuple]:
        """The tiles of a part that meet the window, which has to be the whole part's at most."""
        head = geotiff_header(name)
        (h, w), across = head.block, -(-head.shape[1] // head.block[1])
        a, b = max(r0 - row, 0), min(r1 - row, head.shape[0])
        x, y = max(c0 - col, 0), min(c1 - col, head.shape[1])
        return [(name, row, col, k, head.offsets[k], head.counts[k]) for i in range(a // h, -(-b // h)) for j in range(x // w, -(-y // w)) for k in [i * across + j]] if a < b and x < y else []

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if found := tiles_of(r["name"], r["row"], r["col"]):
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=["name", "row", "col", "tile", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[str, Tiff] = {}
        for batch in batches:
            for t in batch.to_pylist():
                head = heads.setdefault(t["name"], geotiff_header(t["name"]) if t["name"] not in heads else None)
                (h, w), across, dtype = head.block, -(-head.shape[1] // head.block[1]), np.dtype(head.dtype)
                top, left = t["tile"] // across * h, t["tile"] % across * w
                high = h if head.tiled else min(h, head.shape[0] - top)
                files, root = _files(t["name"])
                with files.open_input_file(root) as f:
                    f.seek(t["at"])
                    raw = f.read(t["n"])
                raw = zlib.decompress(raw) if head.compression != 1 else raw
                a = np.frombuffer(raw, dtype, high * w).reshape(high, w)
                if head.predictor == 2:
                    u = a.view(f"{dtype.str[0]}u{dtype.itemsize}")
                    a = np.cumsum(u, axis=1, dtype=f"u{dtype.itemsize}").view(dtype.newbyteorder("="))
                a = a[: head.shape[0] - top, : head.shape[1] - left]
                y, x = top + t["row"], left + t["col"]
                a = a[max(r0 - y, 0) : max(r1 - y, 0), max(c0 - x, 0) : max(c1 - x, 0)]
                i, j = (k.ravel().astype(np.int32) + np.int32(n) for k, n in zip(np.indices(a.shape), (max(y, r0), max(x, c0)), strict=True))
                for grid, values in ({"re": a.real, "im": a.imag} if dtype.kind == "c" else {"v": a}).items():
                    v = values.astype(float).ravel()
                    gone = ~np.isfinite(v) if head.nodata is None else ~np.isfinite(v) | (v == head.nodata)
                    yield pa.RecordBatch.from_arrays([pa.array([grid]).take(pa.array(np.zeros(len(v), np.int32))), pa.array(i), pa.array(j), pa.array(v, mask=gone)], names=["grid_id", "row", "col", "v"])

    fields = "name string, row int, col int, tile long, at long, n long"
    if len(parts) > 1:
        meet = spark.createDataFrame(parts, "name string, row int, col int").repartition(max(1, min(len(parts), 1024)))
        tiles = meet.mapInArrow(listed, fields)
    else:
        # one row for each tile that meets the window
        found = [t for p in parts for t in tiles_of(*p)]
        tiles = spark.createDataFrame(found, fields).repartition(max(1, min(len(found), 1024)))
    return tiles.mapInArrow(run, RASTER)


def open_raster(spark: SparkSession, path: str, shape: tuple[int, int], dtype: str, rows: slice = slice(None), cols: tuple[int, int] | None = None) -> DataFrame:
    """RASTER rows of a headerless binary if the file has just the bytes of the shape, else of a GeoTIFF of that shape.

    rows is a contiguous slice whose negative ends count from the last row; only its rows are read.
    """
    first, stop, step = rows.indices(shape[0])
    if step != 1:
        raise ValueError("rows have to be contiguous")
    files, root = _files(path)
    if files.get_file_info(root).size == shape[0] * shape[1] * np.dtype(dtype).itemsize:
        out = read_flat(spark, path, shape, dtype, rows=(first, max(first, stop)))
        return out if cols is None else out.where((F.col("col") >= cols[0]) & (F.col("col") < cols[1]))
    if raster_shape(path) != tuple(shape):
        raise ValueError(f"{path} is {raster_shape(path)}, not {tuple(shape)}")
    return read_geotiff(spark, path, (first, max(first, stop)), cols)
