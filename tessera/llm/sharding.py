"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order and get the fractional rank (rank - 1/2) / rows; sorted by it, every
stretch of the sequence holds the sources in proportion, and equal cuts make shards that match the mixture. Both sorts
are distributed: rows fall into key ranges of bounded size within the source and later into ranges of the fractional
rank, whose counts are summed up to offsets; a window then ranks inside a range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, written
from .mixing import key_range, n_ranges, order_key

SHARDS = 16
SEED = "shard-1"


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, columns: list[str] | None = None) -> DataFrame:
    """docs (doc_id, source, ...) with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    The law is `rows`: counts of shards are at most one apart, and so are a source's counts but for the rounding of
    its neighbours. Null sources are a source of their own; rows without doc_id are ordered by a hash of their columns; rows that repeat
    a doc_id take neighbouring places of their source's order, by a hash of their columns. Fewer rows than shards leave the last shards
    empty; no rows give no rows. columns: which columns of docs stay (all by default); shard and slot are replaced.
    """
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("shard", "slot")]
    key = order_key(seed, F.xxhash64(*names).cast("string"))
    slim = _assigned(docs.select(F.col("source").alias("sh_source"), key.alias("sh_key")), n_shards)
    # the places of the rows of one doc_id
    places = slim.groupBy(F.col("sh_source").alias("p_source"), F.col("sh_key").alias("p_key")).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    same = W.partitionBy("sh_source", "sh_key").orderBy(F.xxhash64("row"), F.xxhash64(F.lit(1), "row"))
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").alias("sh_source"), key.alias("sh_key")).withColumn("sh_nth", F.row_number().over(same))
    rows = rows.join(places.hint("shuffle_merge"), F.col("sh_source").eqNullSafe(F.col("p_source")) & (F.col("sh_key") == F.col("p_key")))
    place = F.element_at("places", F.col("sh_nth"))
    return rows.select("row.*", place["shard"].alias("shard"), place["slot"].alias("slot"))


def _assigned(rows: DataFrame, n_shards: int) -> DataFrame:
    """(sh_source, sh_key, shard, slot) of the rows (sh_source, sh_key)."""
    counts = rows.groupBy(F.col("sh_source").alias("c_source")).agg(F.count("*").alias("sh_rows")).withColumn("sh_ranges", n_ranges(F.col("sh_rows")))
    counts = written(counts.withColumn("sh_all", F.sum("sh_rows").over(W.partitionBy())), "shard-counts")
    # one row for each source
    rows = rows.join(small(counts, counts.count(), 64), F.col("sh_source").eqNullSafe(F.col("c_source"))).drop("c_source").withColumn("sh_range", key_range(F.col("sh_key"), F.col("sh_ranges")))
    place = F.row_number().over(W.partitionBy("sh_source", "sh_range").orderBy("sh_key"))
    by_range = rows.groupBy(F.col("sh_source").alias("r_source"), F.col("sh_range").alias("r_range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("r_source").orderBy("r_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumn("sh_place", place).join(by_range.select("r_source", "r_range", before.alias("sh_before")), F.col("sh_source").eqNullSafe(F.col("r_source")) & (F.col("sh_range") == F.col("r_range"))).drop("r_source", "r_range")
    # 2 * rank - 1 over 2 * rows, as a double for the order and as whole numbers for the range
    twice = 2 * (F.col("sh_before") + F.col("sh_place")) - 1
    rows = rows.withColumn("sh_frac", twice / (2 * F.col("sh_rows"))).withColumn("sh_step", F.floor(F.col("sh_frac") * n_ranges(F.col("sh_all"))).cast("long"))
    steps = rows.groupBy(F.col("sh_step").alias("r_step")).agg(F.count("*").alias("n"))
    # one row for each RANGE_ROWS rows
    offset = F.coalesce(F.sum("n").over(W.orderBy("r_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inner = F.row_number().over(W.partitionBy("sh_step").orderBy("sh_frac", F.col("sh_source").isNull(), F.col("sh_source").cast("binary"), "sh_key")) - 1
    rows = rows.withColumn("sh_inner", inner).join(steps.select("r_step", offset.alias("sh_offset")), F.col("sh_step") == F.col("r_step"))
    rows = rows.withColumn("sh_at", F.col("sh_offset") + F.col("sh_inner")).withColumn("shard", F.expr(f"(sh_at * {n_shards}) div sh_all").cast("int"))
    first = F.expr(f"(shard * sh_all + {n_shards - 1}) div {n_shards}")
    return rows.select("sh_source", "sh_key", "shard", (F.col("sh_at") - first).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shards(docs, columns=["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_sql(rows: str, columns: str) -> str:
    """SQL of shards over a table, with the named columns of its rows; doc_ids aren't null."""
    return f"""
SELECT {columns}, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * n_all + 15) // 16 AS BIGINT) AS slot FROM (
  SELECT *, (pos * 16) // n_all AS shard FROM (
    SELECT *, row_number() OVER (ORDER BY (2 * place - 1)::DOUBLE / (2 * n_source)::DOUBLE, source IS NULL, encode(source), sh_key) - 1 AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY sh_key) AS place FROM (
        SELECT *, md5('shard-1:' || doc_id) AS sh_key, count(*) OVER () AS n_all, count(*) OVER (PARTITION BY source) AS n_source FROM {rows}))))"""


OP9_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS b, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT *, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])) AS v FROM d, crc),
p AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(xor(v, 4294967295) AS BIGINT) AS text_crc32 FROM d JOIN c USING (r))
""" + shard_sql("p", "doc_id, size, text_crc32, 'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard")
