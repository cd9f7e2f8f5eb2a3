"""Lattices, image pairs, stacks, bands and shapes derived from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT_SHAPE = (96, 64)
PAIR_SHAPE = (240, 128)
STACK_SHAPE = (48, 48)
#: Carriers of the two bands, MHz.
FA, FB = 1239.0, 1293.5


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cells(df: DataFrame, rows: int, cols: int) -> DataFrame:
    return df.withColumn("row", (F.col("l_orderkey") % rows).cast("int")).withColumn("col", (F.col("l_partkey") % cols).cast("int"))


def lattice(spark: SparkSession, d: str) -> DataFrame:
    g = _cells(table(spark, d, "lineitem"), *LAT_SHAPE).groupBy("row", "col").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))
    return g.select("row", "col", F.round(3 * F.sin(F.col("row") / 12.0) + 20 * (F.col("a") - 0.05), 9).alias("azimuth"), F.round(20 * (F.col("t") - 0.04), 9).alias("range"), F.round(F.col("q") / 3, 9).alias("snr"))


def slc_pair(spark: SparkSession, d: str) -> DataFrame:
    g = _cells(table(spark, d, "lineitem"), *PAIR_SHAPE).groupBy("row", "col").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"), F.avg("l_discount").alias("a"), F.avg("l_tax").alias("t"))
    amp, ref = F.col("s") / (math.pi * 1e5), 20 * math.pi * F.col("a")
    sec = ref + F.col("row") / 40.0 + 2 * math.pi * F.col("t")
    return g.select("row", "col", *[F.round(amp * f(p), 6).alias(n) for n, f, p in (("r_re", F.cos, ref), ("r_im", F.sin, ref), ("s_re", F.cos, sec), ("s_im", F.sin, sec))])


def stack(spark: SparkSession, d: str) -> DataFrame:
    g = _cells(table(spark, d, "lineitem"), *STACK_SHAPE).groupBy(F.year("l_shipdate").cast("string").alias("d"), "row", "col")
    part = lambda f: F.round(F.sum(F.col("l_extendedprice") * f(20 * math.pi * F.col("l_discount"))) / (math.pi * 1e5), 5)
    return g.agg(part(F.cos).alias("re"), part(F.sin).alias("im")).withColumn("freq", F.lit("A"))


def bands(spark: SparkSession, d: str) -> DataFrame:
    n, dd = F.col("range"), F.col("azimuth")
    coh = F.least(F.lit(1.0), F.col("snr") / 20)
    return lattice(spark, d).select("row", "col", (n + dd).alias("phi_a"), (n * (FB / FA) + dd * (FA / FB)).alias("phi_b"), coh.alias("coh"), "azimuth", "range")


def kept(spark: SparkSession, d: str, least: float = 8.0) -> DataFrame:
    """The lattice as (row, col, v): azimuth where snr is high enough, else null."""
    return lattice(spark, d).select("row", "col", F.when(F.col("snr") >= least, F.col("azimuth")).alias("v"))


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (F.lit(-150.0) + (k % 100) / 10.0).alias("x"), (F.lit(60.0) + (k % 50) / 10.0).alias("y"), F.col("c_acctbal").alias("v"))


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """A triangle for each region."""
    k = F.col("r_regionkey")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0 = -150.0 + 2 * k, 60.0 + k * 0.5
    return table(spark, d, "region").select(k.alias("id"), F.array(p(x0 + 0.013, y0 + 0.017), p(x0 + 1.87, y0 + 0.21), p(x0 + 0.91, y0 + 3.03)).alias("ring"))


def spectrum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select("row", "col", F.col("v").cast("double").alias("v"))


LAT = """lat AS (SELECT CAST(l_orderkey % 96 AS INT) AS i, CAST(l_partkey % 64 AS INT) AS j,
  round(3 * sin((l_orderkey % 96) / 12.0::DOUBLE) + 20 * (avg(l_discount) - 0.05::DOUBLE), 9) AS azimuth,
  round(20 * (avg(l_tax) - 0.04::DOUBLE), 9) AS range_, round(avg(l_quantity) / 3, 9) AS snr
  FROM lineitem GROUP BY l_orderkey % 96, l_partkey % 64)"""
PAIR = """pr0 AS (SELECT CAST(l_orderkey % 240 AS INT) AS i, CAST(l_partkey % 128 AS INT) AS j, round(sum(l_extendedprice), 2) / (pi() * 1e5::DOUBLE) AS amp,
  20 * pi() * avg(l_discount) AS rp, 20 * pi() * avg(l_discount) + (l_orderkey % 240) / 40.0::DOUBLE + 2 * pi() * avg(l_tax) AS sp
  FROM lineitem GROUP BY l_orderkey % 240, l_partkey % 128),
pr AS (SELECT i, j, round(amp * cos(rp), 6) AS r_re, round(amp * sin(rp), 6) AS r_im, round(amp * cos(sp), 6) AS s_re, round(amp * sin(sp), 6) AS s_im FROM pr0)"""
STACK = """st AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS d, CAST(l_orderkey % 48 AS INT) AS i, CAST(l_partkey % 48 AS INT) AS j,
  round(sum(l_extendedprice * cos(20 * pi() * l_discount)) / (pi() * 1e5::DOUBLE), 5) AS re, round(sum(l_extendedprice * sin(20 * pi() * l_discount)) / (pi() * 1e5::DOUBLE), 5) AS im
  FROM lineitem GROUP BY 1, 2, 3)"""
ACC = STACK + """,
own AS (SELECT d, i // 4 AS i, j // 4 AS j, sum(re * re + im * im) AS p, count(*) FILTER (WHERE re <> 0 OR im <> 0) AS ok FROM st GROUP BY 1, 2, 3),
zz AS (SELECT a.d AS d1, b.d AS d2, a.i // 4 AS i, a.j // 4 AS j, sum(a.re * b.re + a.im * b.im) AS z_re, sum(a.im * b.re - a.re * b.im) AS z_im
  FROM st a JOIN st b ON a.i = b.i AND a.j = b.j AND a.d < b.d GROUP BY 1, 2, 3, 4),
acc AS (SELECT zz.*, x.p AS p1, y.p AS p2, least(x.ok, y.ok) / 16.0::DOUBLE AS n FROM zz JOIN own x ON x.d = d1 AND x.i = zz.i AND x.j = zz.j JOIN own y ON y.d = d2 AND y.i = zz.i AND y.j = zz.j),
coh AS (SELECT *, n > 0.5 AND p1 > 0 AND p2 > 0 AS valid, CASE WHEN n > 0.5 AND p1 > 0 AND p2 > 0 THEN least(1.0::DOUBLE, sqrt(z_re * z_re + z_im * z_im) / sqrt(p1 * p2)) ELSE 0 END AS coh FROM acc)"""
BANDS = LAT + """,
bd AS (SELECT i, j, range_ + azimuth AS phi_a, range_ * (1293.5::DOUBLE / 1239.0::DOUBLE) + azimuth * (1239.0::DOUBLE / 1293.5::DOUBLE) AS phi_b, least(1.0::DOUBLE, snr / 20) AS coh, azimuth, range_ FROM lat)"""
KEPT = LAT + ", k AS (SELECT i, j, CASE WHEN snr >= 8 THEN azimuth END AS v FROM lat)"
POINTS = "pt AS (SELECT c_custkey AS id, -150.0::DOUBLE + (c_custkey % 100) / 10.0::DOUBLE AS x, 60.0::DOUBLE + (c_custkey % 50) / 10.0::DOUBLE AS y, c_acctbal AS v FROM customer)"
SPECTRUM = "em AS (SELECT CAST(vec_id AS INT) AS i, CAST(unnest(range(0, len(embedding))) AS INT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
