"""Granules as a data source of Spark: image samples by chunk, and the axes, orbit, radar and map grids beside them.

A granule is a folder of chunked arrays (Zarr, version 2) under the group paths of the radar products: focused images
(`radargrid`, `orbit`, `dop`, `slc`), slant-range products (`science/*/RSLC`) and map-grid products (`science/*/GSLC`).
`spark.read.format("granule")` takes one granule or a folder of granules. Its option `table` is one of TABLES; `granules`
(names, comma-joined), `rows` and `cols` ("first:after") say on the driver which chunks are planned, so no task opens another
chunk. These are options and not pushed filters, as Spark 4.1 keeps what one query pushes into a Python source for every
later query of the same DataFrame, which then misses rows; filters of a DataFrame are left to Spark.

Samples are planned as runs of neighbouring chunks of about RUN_BYTES, and a task holds one chunk at a time. A chunk that
isn't there holds the fill value, as the format has it. Files go through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RUN_BYTES = 16_000_000
LIGHT = 299792458.0
TABLES = {
    "samples": "granule string, row int, col int, re float, im float",
    "axes": "granule string, axis string, i int, v double",
    "orbit": "granule string, i int, t double, x double, y double, z double, vx double, vy double, vz double",
    "doppler": "granule string, i int, j int, y double, x double, v double",
    "radar": "granule string, kind string, frequency string, rows int, cols int, fc double, wavelength double, sensing_start double, prf double, starting_range double, range_spacing double, lookside string, epoch string",
    "grids": "granule string, frequency string, rows int, cols int, x0 double, dx double, y0 double, dy double, fc double, bw double, azbw double, epsg int, delay double",
}


def files_of(path: str):
    """(file system, path on it) of a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class Store:
    """The arrays and attributes of one granule."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.name = self.path.rsplit("/", 1)[-1]
        self._fs, self._root = files_of(self.path)

    def _read(self, name: str) -> bytes | None:
        try:
            with self._fs.open_input_stream(f"{self._root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def children(self, group: str) -> list[str]:
        from pyarrow import fs

        found = self._fs.get_file_info(fs.FileSelector(f"{self._root}/{group}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def attributes(self, group: str) -> dict | None:
        raw = self._read(f"{group}/.zattrs")
        return None if raw is None else json.loads(raw)

    def about(self, name: str) -> dict | None:
        """What is known of an array, or None if there is none."""
        raw = self._read(f"{name}/.zarray")
        return None if raw is None else json.loads(raw)

    def chunk(self, name: str, about: dict, at: Sequence[int]) -> np.ndarray:
        dtype = _dtype(about["dtype"])
        raw = self._read(f"{name}/{about.get('dimension_separator', '.').join(map(str, at)) or '0'}")
        if raw is None:
            return np.full(about["chunks"], 0 if about["fill_value"] is None or dtype.names else about["fill_value"], dtype)
        return np.frombuffer(_inflated(raw, about["compressor"]), dtype).reshape(about["chunks"], order=about["order"])

    def array(self, name: str) -> np.ndarray | None:
        """A whole small array: an axis, an orbit, a constant."""
        about = self.about(name)
        if about is None:
            return None
        shape, chunks = about["shape"], about["chunks"]
        out = np.zeros(shape, _dtype(about["dtype"]))
        for at in np.ndindex(*[-(-n // c) for n, c in zip(shape, chunks, strict=True)]):
            place = tuple(slice(k * c, min(n, (k + 1) * c)) for k, c, n in zip(at, chunks, shape, strict=True))
            out[place] = self.chunk(name, about, at)[tuple(slice(0, p.stop - p.start) for p in place)]
        return out

    def number(self, *names: str) -> float | None:
        """The first of some scalars that is there."""
        for name in names:
            if (a := self.array(name)) is not None:
                return float(np.asarray(a).reshape(-1)[0])
        return None


def _dtype(text) -> np.dtype:
    return np.dtype([(n, t) for n, t in text]) if isinstance(text, list) else np.dtype(text)


def _inflated(raw: bytes, how: dict | None) -> bytes:
    if how is None:
        return raw
    if how["id"] in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if how["id"] == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31)
    raise ValueError(f"chunks are packed by {how['id']}")


def parts_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts as 32-bit floats, of complex numbers or of pairs of half or other floats."""
    if a.dtype.names:
        re, im = a.dtype.names
        return a[re].astype(np.float32), a[im].astype(np.float32)
    return (a.real.astype(np.float32), a.imag.astype(np.float32)) if a.dtype.kind == "c" else (a.astype(np.float32), np.zeros(a.shape, np.float32))


def _product(store: Store, kind: str) -> str | None:
    """The group of a product below science, whatever band it is of."""
    return next((f"science/{b}/{kind}" for b in store.children("science") if kind in store.children(f"science/{b}")), None)


def _frequency(store: Store, group: str, freq: str) -> str:
    if f"frequency{freq}" not in (there := [c for c in store.children(group) if c.startswith("frequency")]):
        raise ValueError(f"{store.name} has no frequency{freq}, but {', '.join(there) or 'none'}")
    return f"{group}/frequency{freq}"


def image_of(store: Store, freq: str, pol: str) -> tuple[str, str]:
    """(kind, name of the array) of a granule's image."""
    if store.attributes("radargrid") is not None:
        return "focused", "slc"
    if (product := _product(store, "RSLC")) is not None:
        kind, group = "RSLC", f"{product}/swaths"
    elif (product := _product(store, "GSLC")) is not None:
        kind, group = "GSLC", f"{product}/grids"
    else:
        raise ValueError(f"{store.name} is no granule")
    name = f"{_frequency(store, group, freq)}/{pol}"
    if store.about(name) is None:
        raise ValueError(f"{store.name} has no {pol} at frequency{freq}, but {', '.join(store.children(name.rsplit('/', 1)[0])) or 'none'}")
    return kind, name


def _swaths(store: Store, freq: str) -> tuple[str, str]:
    product = _product(store, "RSLC")
    if product is None:
        raise ValueError(f"{store.name} has no swaths")
    return product, _frequency(store, f"{product}/swaths", freq)


def _axes(store: Store, freq: str, pol: str) -> Iterator[tuple]:
    if (g := store.attributes("radargrid")) is not None:
        yield from ((store.name, "azimuth", k, g["sensing_start"] + k / g["prf"]) for k in range(int(g["length"])))
        yield from ((store.name, "range", k, g["starting_range"] + k * g["range_pixel_spacing"]) for k in range(int(g["width"])))
        return
    product, group = _swaths(store, freq)
    for axis, name in (("azimuth", f"{product}/swaths/zeroDopplerTime"), ("range", f"{group}/slantRange")):
        yield from ((store.name, axis, k, float(v)) for k, v in enumerate(store.array(name)))


def _orbit(store: Store, freq: str, pol: str) -> Iterator[tuple]:
    group = "orbit" if store.attributes("radargrid") is not None else f"{_swaths(store, freq)[0]}/metadata/orbit"
    t, p, v = (store.array(f"{group}/{n}") for n in ("time", "position", "velocity"))
    if t is None or p is None:
        raise ValueError(f"{store.name} has no orbit")
    if v is None:
        v = np.gradient(p, t, axis=0)
    for k in range(len(t)):
        yield (store.name, k, float(t[k]), *map(float, p[k]), *map(float, v[k]))


def _doppler(store: Store, freq: str, pol: str) -> Iterator[tuple]:
    if store.attributes("radargrid") is not None:
        names = ("dop/y", "dop/x", "dop/data")
    else:
        group = f"{_swaths(store, freq)[0]}/metadata/processingInformation/parameters"
        names = (f"{group}/zeroDopplerTime", f"{group}/slantRange", f"{group}/frequency{freq}/dopplerCentroid")
    y, x, v = (store.array(n) for n in names)
    if v is not None:
        yield from ((store.name, i, j, float(y[i]), float(x[j]), float(v[i, j])) for i, j in np.ndindex(*v.shape))


def _radar(store: Store, freq: str, pol: str) -> Iterator[tuple]:
    kind, image = image_of(store, freq, pol)
    rows, cols = store.about(image)["shape"]
    if kind == "focused":
        g = store.attributes("radargrid")
        side = "right" if str(g["lookside"]).lower().startswith("r") else "left"
        yield (store.name, kind, freq, rows, cols, LIGHT / g["wavelength"], float(g["wavelength"]), float(g["sensing_start"]), float(g["prf"]), float(g["starting_range"]), float(g["range_pixel_spacing"]), side, str(g["ref_epoch"]))
        return
    product, group = _swaths(store, freq)
    t, r = store.array(f"{product}/swaths/zeroDopplerTime"), store.array(f"{group}/slantRange")
    fc = store.number(f"{group}/processedCenterFrequency", f"{group}/acquiredCenterFrequency")
    about = store.attributes(f"{product}/swaths") or {}
    side = "right" if str(about.get("lookside", "left")).lower().startswith("r") else "left"
    yield (store.name, kind, freq, rows, cols, fc, fc and LIGHT / fc, float(t[0]), float((len(t) - 1) / (t[-1] - t[0])), float(r[0]), float((r[-1] - r[0]) / (len(r) - 1)), side, str(about.get("epoch", "")))


def _grids(store: Store, freq: str, pol: str) -> Iterator[tuple]:
    product = _product(store, "GSLC")
    if product is None:
        raise ValueError(f"{store.name} has no map grids")
    for f in freq or "AB":
        group = _frequency(store, f"{product}/grids", f)
        image = store.about(f"{group}/{pol}")
        if image is None:
            raise ValueError(f"{store.name} has no {pol} at frequency{f}")
        number = lambda name, g=group: store.number(f"{g}/{name}")
        epsg = number("projection")
        yield (store.name, f, *image["shape"], number("xCoordinates"), number("xCoordinateSpacing"), number("yCoordinates"), number("yCoordinateSpacing"), number("centerFrequency"), number("rangeBandwidth"), number("azimuthBandwidth"), None if epsg is None else int(epsg), store.number(f"{product}/metadata/calibrationInformation/frequency{f}/commonDelay"))


_SMALL = {"axes": _axes, "orbit": _orbit, "doppler": _doppler, "radar": _radar, "grids": _grids}


@dataclass
class Run(InputPartition):
    """Neighbouring chunks of one row of chunks of an image, or all of a small table of a granule."""

    path: str
    image: str | None
    row: int
    first: int
    last: int


def _range(text: str) -> tuple[int, int]:
    low, high = text.split(":")
    return int(low or 0), int(high or 1 << 31)


class GranuleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "samples")
        self.pol = options.get("polarization", "HH")
        self.freq = options.get("frequency", "" if self.table == "grids" else "A")
        self.only = {n for n in options.get("granules", "").split(",") if n}
        self.window = {axis: _range(options.get(f"{axis}s", ":")) for axis in ("row", "col")}

    def _wanted(self, axis: str, at: np.ndarray) -> np.ndarray:
        low, high = self.window[axis]
        return (at >= low) & (at < high)

    def _stores(self) -> list[Store]:
        root = Store(self.path)
        found = [root] if root._read(".zgroup") is not None else [Store(f"{self.path}/{c}") for c in root.children("")]
        return [s for s in found if (not self.only or s.name in self.only) and s._read(".zgroup") is not None]

    def partitions(self) -> list[Run]:
        stores = self._stores()
        if self.table != "samples":
            return [Run(s.path, None, 0, 0, 0) for s in stores]
        runs = []
        for s in stores:
            image = image_of(s, self.freq, self.pol)[1]
            about = s.about(image)
            (rows, cols), (h, w) = about["shape"], about["chunks"]
            each = max(1, RUN_BYTES // (h * w * _dtype(about["dtype"]).itemsize))
            touched = lambda axis, size, n: [k for k in range(-(-n // size)) if self._wanted(axis, np.arange(k * size, min(n, (k + 1) * size))).any()]
            across = touched("col", w, cols)
            for i in touched("row", h, rows):
                at = 0
                while at < len(across):
                    last = at
                    while last + 1 < len(across) and last + 1 - at < each and across[last + 1] == across[last] + 1:
                        last += 1
                    runs.append(Run(s.path, image, i, across[at], across[last] + 1))
                    at = last + 1
        return runs

    def read(self, run: Run | None) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if run is None:
            # nothing is planned
            return
        store = Store(run.path)
        if run.image is None:
            yield from _SMALL[self.table](store, self.freq, self.pol)
            return
        about = store.about(run.image)
        (rows, cols), (h, w) = about["shape"], about["chunks"]
        for j in range(run.first, run.last):
            r, c = np.arange(run.row * h, min(rows, (run.row + 1) * h)), np.arange(j * w, min(cols, (j + 1) * w))
            own_r, own_c = self._wanted("row", r), self._wanted("col", c)
            a = store.chunk(run.image, about, (run.row, j))[: len(r), : len(c)][np.ix_(own_r, own_c)]
            re, im = (x.ravel() for x in parts_of(a))
            r, c = np.repeat(r[own_r], own_c.sum()), np.tile(c[own_c], own_r.sum())
            yield pa.RecordBatch.from_arrays([pa.array([store.name]).take(pa.array(np.zeros(len(r), np.int32))), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(re), pa.array(im)], names=["granule", "row", "col", "re", "im"])


class GranuleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granule"

    def schema(self) -> str:
        table = self.options.get("table", "samples")
        if table not in TABLES:
            raise ValueError(f"no table {table!r}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> GranuleReader:
        return GranuleReader(dict(self.options))


Window = tuple[int, int]


def read_granules(spark: SparkSession, path: str, table: str = "samples", rows: Window | None = None, cols: Window | None = None, **options: str) -> DataFrame:
    """A table of the granules at a path, of samples those in a window (first, after the last); other options are frequency,
    polarization and granules."""
    spark.dataSource.register(GranuleSource)
    window = {name: f"{w[0]}:{w[1]}" for name, w in (("rows", rows), ("cols", cols)) if w}
    return spark.read.format("granule").options(table=table, **window, **options).load(path)


def load_slc(spark: SparkSession, path: str, freq: str = "A", pol: str = "HH", rows: Window | None = None, cols: Window | None = None) -> dict[str, DataFrame]:
    """samples, radar, orbit and doppler of focused images and slant-range products."""
    window = {"rows": rows, "cols": cols}
    return {name: read_granules(spark, path, name, frequency=freq, polarization=pol, **(window if name == "samples" else {})) for name in ("samples", "radar", "orbit", "doppler")}


def swath_axes(spark: SparkSession, path: str, freq: str, pol: str = "HH") -> dict[str, DataFrame]:
    """axes (zero-Doppler times and slant ranges), orbit and radar (centre frequency, shape) of granules."""
    return {name: read_granules(spark, path, name, frequency=freq, polarization=pol) for name in ("axes", "orbit", "radar")}


def grid_of(spark: SparkSession, path: str, pol: str = "HH") -> DataFrame:
    """Map grids of both frequencies of granules, with what they know of bandwidth, projection and range calibration."""
    return read_granules(spark, path, "grids", polarization=pol)


def same_azimuth(a: DataFrame, b: DataFrame) -> DataFrame:
    """(granule, n_a, n_b, most, same): whether the azimuth axes of two tables of axes agree, line by line."""
    one = lambda df, v: df.where("axis = 'azimuth'").select("granule", "i", F.col("v").alias(v))
    both = one(a, "a").join(one(b, "b"), ["granule", "i"], "full")
    out = both.groupBy("granule").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max(F.abs(F.col("a") - F.col("b"))).alias("most"))
    return out.withColumn("same", (F.col("n_a") == F.col("n_b")) & (F.coalesce("most", F.lit(0.0)) == 0))


# ---- writing ---------------------------------------------------------------------------------------------------------
def _put(fs, path: str, data: bytes) -> None:
    """Writes beside the place and renames, so that a file is there whole or not at all, however often a task runs."""
    folder = path.rsplit("/", 1)[0]
    fs.create_dir(folder, recursive=True)
    beside = f"{folder}/.part-{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(data)
    fs.move(beside, path)


def _about(dtype, shape: Sequence[int], chunks: Sequence[int], packed: bool) -> bytes:
    kind = [[n, dtype[n].str] for n in dtype.names] if dtype.names else dtype.str
    return json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": kind, "compressor": {"id": "zlib", "level": 1} if packed else None, "fill_value": None if dtype.names else 0, "order": "C", "filters": None}).encode()


def write_array(path: str, name: str, value) -> None:
    """A small array of a granule, in one chunk, from the driver."""
    fs, root = files_of(path.rstrip("/"))
    a = np.asarray(value)
    _put(fs, f"{root}/{name}/{'.'.join('0' * a.ndim) or '0'}", a.tobytes())
    _put(fs, f"{root}/{name}/.zarray", _about(a.dtype, a.shape, a.shape, False))


def write_attributes(path: str, group: str, values: dict) -> None:
    fs, root = files_of(path.rstrip("/"))
    _put(fs, f"{root}/{group}/.zattrs", json.dumps(values).encode())


def write_image(df: DataFrame, path: str, name: str, shape: tuple[int, int], chunks: tuple[int, int] = (512, 512), half: bool = False) -> int:
    """The cells of df (row, col, re, im) as a chunked image of a granule; returns the number of chunks.

    A chunk is one group and one file, which its task renames into place. Missing cells and nulls are 0, and chunks without
    cells have no file; of a cell that comes twice any one is taken; cells outside the shape are an error. The
    image is readable once all its chunks are there, as what describes it is written last.
    """
    (h, w), (rows, cols) = chunks, shape
    dtype = np.dtype([("r", "<f2"), ("i", "<f2")]) if half else np.dtype("<c8")

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((h, w), dtype)
        r, c = pdf["row"].to_numpy() % h, pdf["col"].to_numpy() % w
        re, im = (pdf[n].to_numpy(float, na_value=0.0) for n in ("re", "im"))
        if half:
            a["r"][r, c], a["i"][r, c] = re, im
        else:
            a[r, c] = re + 1j * im
        i, j = int(pdf["ci"].iloc[0]), int(pdf["cj"].iloc[0])
        fs, root = files_of(path.rstrip("/"))
        _put(fs, f"{root}/{name}/{i}.{j}", zlib.compress(a.tobytes(), 1))
        return pd.DataFrame({"ci": [i], "cj": [j]})

    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    ci = F.when(inside, F.expr(f"row div {h}")).otherwise(F.raise_error(F.lit("a cell lies outside the image")).cast("long"))
    dealt = df.select("row", "col", "re", "im", ci.cast("int").alias("ci"), F.expr(f"cast(col div {w} as int)").alias("cj"))
    n = dealt.groupBy("ci", "cj").applyInPandas(put, "ci int, cj int").count()
    fs, root = files_of(path.rstrip("/"))
    _put(fs, f"{root}/{name}/.zarray", _about(dtype, shape, chunks, True))
    return n


def close_granule(path: str) -> None:
    """Marks a granule as complete; readers of a folder of granules pass over others."""
    fs, root = files_of(path.rstrip("/"))
    _put(fs, f"{root}/.zgroup", b'{"zarr_format": 2}')
