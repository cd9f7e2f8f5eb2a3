"""Mixing sources to target weights: budgets by water-filling, then exact cuts in a random order within each source.

Everything is DataFrame code. A row's random key is the md5 of a seed and its doc_id; the key's first 32 bits choose
one of 2**k equal ranges within the source, so rows are range-partitioned by (source, range) without sampling. Prefix
sums are distributed: sums by range, a running sum over the ranges of a source, and a running sum inside each range.
A source of any share of the rows spreads over its ranges, each of which holds about RANGE_ROWS rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_spaced_words, small, table, written

RANGE_ROWS = 5_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def order_key(seed: str, else_by: Column) -> Column:
    """A random order of rows by seed and doc_id; rows without doc_id are ordered by another column, so that they spread."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), else_by))).cast("binary"))


def key_range(key: Column, ranges: Column) -> Column:
    """Which of the equal ranges of the key's first 32 bits it lies in; ranges is a power of two, of 2**31 at most."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")


def n_ranges(rows: Column) -> Column:
    """The power of two that leaves about RANGE_ROWS rows in a range."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(rows / F.lit(RANGE_ROWS), F.lit(1.0))))).cast("long")


def budgets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ...) with target, by water-filling.

    Sources by code point, null last, weigh `weights` in turn. They share `share` times all sizes by weight; a target
    stops at `most` times its source's size and the excess goes to the others by weight, until none is above. The level
    at which that settles is found in one pass over the sources in order of most * size / weight: the first one whose
    cap reaches the level of all that is left; from there on levels only fall, so it is the highest such level. There is one row for each source here, whatever the number of documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    capped, weighed = (F.coalesce(F.sum(c).over(every), F.lit(0.0)) for c in ("cap", "weight"))
    out = out.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - capped) / (F.sum("weight").over(whole) - weighed))
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole)
    out = out.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return out.drop("weight", "cap", "ratio", "level")


def mixture(docs: DataFrame, columns: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and mix_taken.

    mix_size is the number of words of the text, mix_taken the number of words that the mix takes of it, repeats
    counted. A source's words are laid out in random order, epoch after epoch, and cut at its target: whole epochs
    count every document once each, and the last one takes documents until the budget is spent, the one at the cut
    in part. So the words taken of a source are its target to within a word, no document exceeds `most` times its size
    (rounded up to a word), and equal rows get the same result in every run.

    Null texts have size 0 and are never taken. Null sources are a source of their own, last in order. Rows
    without doc_id are ordered by their text. Rows with the same doc_id are cut one after the other, smaller ones first. A source
    without words has target 0. No rows give no rows. columns: which columns of docs stay (all by default); those
    named as a result are replaced.
    """
    results = ("mix_size", "mix_source_size", "mix_target", "mix_taken")
    names = [c for c in (docs.columns if columns is None else columns) if c not in results]
    own = [F.col("doc_id").alias("mix_in_doc_id"), F.col("source").alias("mix_in_source"), n_spaced_words(F.col("text")).alias("mix_size"), order_key(seed, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("mix_key")]
    sizes = written(docs.select(*own), "mix-sizes")
    totals = sizes.groupBy(F.col("mix_in_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = written(budgets(totals, weights, share, most).withColumn("ranges", n_ranges(F.col("source_rows"))).withColumnRenamed("source", "plan_source"), "mix-plan")
    plan = small(plan, plan.count())

    def ranged(rows: DataFrame) -> DataFrame:
        found = rows.join(plan, rows.mix_in_source.eqNullSafe(plan.plan_source)).drop("plan_source")
        return found.withColumn("mix_range", key_range(F.col("mix_key"), F.col("ranges")))

    by_range = ranged(sizes).groupBy("mix_in_source", "mix_range").agg(F.sum("mix_size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("mix_in_source").orderBy("mix_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    before_range = written(by_range.select(F.col("mix_in_source").alias("r_source"), F.col("mix_range").alias("r_range"), before.alias("range_before")), "mix-ranges")
    before_range = small(before_range, before_range.count())
    rows = ranged(docs.select(F.struct(*names).alias("row"), *own))
    inner = F.coalesce(F.sum("mix_size").over(W.partitionBy("mix_in_source", "mix_range").orderBy("mix_key", F.col("mix_in_doc_id"), "mix_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumn("mix_inner", inner).join(before_range, F.col("mix_in_source").eqNullSafe(F.col("r_source")) & (F.col("mix_range") == F.col("r_range")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("mix_size"), rest - F.col("range_before") - F.col("mix_inner")))
    return rows.select("row.*", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (epochs * F.col("mix_size") + part).cast("long").alias("mix_taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN ratio >= level THEN level END) OVER () * weight, cap)) AS target FROM l),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM c
"""
