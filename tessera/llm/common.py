"""What every operator of this subpackage shares: tables, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Kernels cut batches again by bytes, so this only bounds what one batch can hold.
ARROW_ROWS = 512
#: Bytes of a side that may be broadcast; larger sides shuffle.
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, as long texts make batches of the default size too large."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One on this machine is set only where none is named and master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file:///tmp/tessera-checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Scratch tables that this process has made and not deleted.
_OPEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _OPEN.append(path)
    return path


@contextmanager
def lease() -> Iterator[list[str]]:
    """A list that gets the scratch tables made inside the block and still there at its end. What reads them lazily has to be
    written before release() gets the list."""
    before, mine = set(_OPEN), []
    yield mine
    mine += [p for p in _OPEN if p not in before]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables whose last reader is done, and empties the list."""
    for path in paths:
        _delete(spark, path)
        if path in _OPEN:
            _OPEN.remove(path)
    paths.clear()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df in as many partitions as its counted rows need, if these are fewer than a shuffle makes."""
    parts = max(1, -(-rows // each))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in path:
            _delete(spark, path)
            name = path.rsplit("/", 1)[1]
            _OPEN[:] = [p for p in _OPEN if not p.endswith(name)]


def small(df: DataFrame, rows: int, each: int = 16) -> DataFrame:
    """df with a broadcast hint if its counted rows of about `each` bytes are within the limit; else both sides shuffle."""
    return F.broadcast(df) if rows * each <= BROADCAST_BYTES else df.hint("shuffle_merge")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_spaced_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def text_key() -> Column:
    """With doc_id it names a row by what it holds, so that rows with one doc_id and different texts stay apart."""
    return F.xxhash64(F.col("text"))
