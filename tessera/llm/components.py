"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fitted, written

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node that it reaches.

    Nodes are longs. Every group is reduced by partial aggregates and its rows are joined with one row of the group,
    so a component of any size spreads over tasks. The number of rounds grows with the logarithm of the longest path.
    """
    now = written(fitted(edges.where("u <> v").select("u", "v").distinct(), edges.count()), "edges")
    last = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last or mark["n"] == 0:
            break
        last = mark
        before, now = now, written(fitted(_small(_large(now).distinct()).distinct(), 2 * mark["n"]), "edges")
        dropped(before)
    else:
        raise RuntimeError("the components did not settle")
    centre = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centre)
