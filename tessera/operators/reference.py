"""Re-referencing of components, overlap windows and bounding boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = 2 * math.pi


def rereferenced(df: DataFrame, label: str = "label", value: str = "v", ref: str = "ref", most: float = 0.35, least: int = 50, share: float = 0.005) -> DataFrame:
    """df with k and fixed: every component but the largest moved by whole turns towards the reference.

    d is the median of (ref - value) / 2 pi, k = d half to even; components with |d - k| > most, or smaller than
    `least` cells or `share` of all, are dropped. The largest component stays as it is.
    """
    g = df.groupBy(label).agg(F.count("*").alias("n_"), (F.median(F.col(ref) - F.col(value)) / TURN).alias("d_"))
    total = g.agg(F.sum("n_").alias("t_"), F.min_by(label, F.struct(-F.col("n_"), F.col(label))).alias("top_"))
    g = g.crossJoin(F.broadcast(total))
    is_top = F.col(label) == F.col("top_")
    k = F.when(is_top, 0.0).otherwise(F.rint("d_"))
    ok = is_top | ((F.abs(F.col("d_") - F.rint("d_")) <= most) & (F.col("n_") >= least) & (F.col("n_") >= share * F.col("t_")))
    g = g.where(ok).select(label, k.cast("long").alias("k"))
    return df.join(g, label).withColumn("fixed", F.col(value) + F.col("k") * TURN)


def overlap(lo: list[Column], hi: list[Column], pad) -> tuple[Column, Column]:
    """The inset that all windows share, padded inwards on both ends."""
    return F.greatest(*lo) + pad, F.least(*hi) - pad


def boxes_overlap(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id) of boxes (id, x0, y0, x1, y1) that overlap: dealt to tiles, joined on the tile, then compared."""
    tile = lambda c: F.floor(c / size)

    def dealt(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        named = named.withColumn("tx", F.explode(F.sequence(tile(F.col(f"{p}_x0")), tile(F.col(f"{p}_x1")))))
        return named.withColumn("ty", F.explode(F.sequence(tile(F.col(f"{p}_y0")), tile(F.col(f"{p}_y1")))))

    j = dealt(a, "a").join(dealt(b, "b"), ["tx", "ty"])
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    return j.where(meet).select("a_id", "b_id").distinct()


def orientation4(edges: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: the direction in degrees, modulo 90, of edges (vx, vy) longer than a share of the longest, by length."""
    e = edges.withColumn("len_", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)).withColumn("t_", F.atan2("vy", "vx"))
    longest = e.agg(F.max("len_").alias("m_"))
    e = e.crossJoin(F.broadcast(longest)).where(F.col("len_") > share * F.col("m_"))
    return e.agg((F.degrees(F.atan2(F.sum(F.col("len_") * F.sin(4 * F.col("t_"))), F.sum(F.col("len_") * F.cos(4 * F.col("t_"))))) / 4).alias("angle"))
