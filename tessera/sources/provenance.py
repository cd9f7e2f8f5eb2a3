"""Stages of a product as tables that know what they were made of.

A stage's table lies under its name and a digest of its options and of the digests of its inputs. A table that is there in whole
is read instead of made again, so after a change only the stages that depend on it run. Inputs are known by
content: tables by an order-free hash of their rows, folders of files by the names, sizes and times of their files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .granule import files_of

#: Goes into every digest; a change of the operators that changes results has to raise it.
VERSION = 1


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def table_fingerprint(df: DataFrame) -> str:
    """By names, types and rows, whatever their order; repeated rows count. One pass of sums."""
    each = [F.xxhash64(F.lit(k), *[F.col(c) for c in df.columns]).cast("decimal(38,0)") for k in (1, 2)]
    n, *sums = df.agg(F.count("*"), *[F.sum(x) for x in each]).first()
    return _digest(df.dtypes, n, [str(x) for x in sums])


def files_fingerprint(path: str) -> str:
    """By the names, sizes and times of the files below a path."""
    from pyarrow import fs

    files, root = files_of(path.rstrip("/"))
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return _digest(sorted((f.path[len(root) :], f.size, f.mtime_ns) for f in found if f.type == fs.FileType.File))


@dataclass
class Stages:
    """The tables below a folder, and which of them this run made or reused."""

    spark: SparkSession
    root: str
    log: list[tuple[str, str, bool]] = field(default_factory=list)

    def __call__(self, name: str, options: dict, inputs: list[str], make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """(table, digest) of a stage. inputs are digests of other stages and fingerprints; make runs only if the table isn't
        there in whole, which Spark's own mark behind the last file says."""
        digest = _digest(VERSION, name, options, inputs)
        path = f"{self.root}/{name}-{digest}"
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        there = mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)
        if not there:
            make().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
        self.log.append((name, digest, there))
        return self.spark.read.parquet(path), digest
