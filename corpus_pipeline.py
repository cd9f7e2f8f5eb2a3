"""Documents to shards: quality rules, near-dedup, decontamination, mixing and sharding.

Every stage takes (spark, docs, sf_dir), works on all the documents that its predecessor kept, and is written as
Parquet in the shared folder before the next one reads it; its scratch tables go when the next one begins. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, lease, release, small, table, text_key, written
from tessera.llm.decontaminate import OP2_SQL, contamination
from tessera.llm.mixing import OP5_SQL, mixture
from tessera.llm.near_dedup import near_duplicates, near_sql
from tessera.llm.quality import OP8_SQL, verdicts
from tessera.llm.sharding import shard_sql, shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Number and scratch tables of the stage that ran last.
_last: dict[str, int] = {"stage": -1}
_behind: list[str] = []


def _stage(number: int) -> Callable[[Stage], Stage]:
    """A stage that deletes the scratch tables of the one before it, if that ran last: its rows are written once this one
    gets them. A stage called twice, or out of order, deletes nothing."""

    def of(work: Stage) -> Stage:
        @wraps(work)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if number and _last["stage"] == number - 1:
                release(spark, _behind)
            with lease() as mine:
                out = work(spark, docs, sf_dir)
            _last["stage"], _behind[:] = number, mine
            return out

        return run

    return of


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does. Null and empty texts fail; repeated rows are judged alike; no rows
    give no rows. Columns beside those of documents are dropped, here and in every stage."""
    return verdicts(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def _leaders(docs: DataFrame) -> DataFrame:
    """The row with the smallest (doc_id, text key) of each group of near duplicates; every (doc_id, text) is a node."""
    nodes = docs.select(*COLUMNS, text_key().alias("tk")).dropDuplicates(["doc_id", "tk"]).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    found = near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    least = nodes.select("node", "doc_id", "tk").join(found.hint("shuffle_merge"), "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "tk", "node")).alias("least"))
    return nodes.join(least.select("least.node").hint("shuffle_merge"), "node", "left_semi").select(*COLUMNS)


@_stage(1)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): the smallest
    doc_id. Rows of one doc_id and one text are one document, and other texts of a doc_id are documents of their own.
    Rows without doc_id are compared with each other only, and one of each group stays."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("k_id"))
        named = docs.select(*COLUMNS).join(kept.hint("shuffle_merge"), F.col("doc_id") == F.col("k_id"), "left_semi")
        return named.unionByName(docs.select(*COLUMNS).where("doc_id is null"))
    return _leaders(docs.where("doc_id is not null")).unionByName(_leaders(docs.where("doc_id is null")))


@_stage(2)
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Rows that repeat a doc_id are judged each by its own text, those
    without doc_id too; null and empty texts have no windows and stay; without items or documents nothing goes."""
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("h_id"), F.col("tk").alias("h_tk")).distinct()
    hit = written(hit, "contaminated")
    return docs.select(*COLUMNS, text_key().alias("tk")).join(small(hit, hit.count(), 32), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tk") == F.col("h_tk")), "left_anti").select(*COLUMNS)


@_stage(3)
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut counts as taken once more in whole. Null texts
    and texts without words have nothing to take and go; a null source is a source of its own; rows without doc_id are
    ordered by their text; repeated rows are each taken on their own; no rows give no rows."""
    mixed = mixture(docs.select(*COLUMNS))
    times = F.when(F.col("mix_size") > 0, F.ceil(F.col("mix_taken") / F.col("mix_size"))).otherwise(0).cast("int")
    return mixed.withColumn("mix_times", times).where("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*COLUMNS)


@_stage(4)
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of its own proportions, whose counts are at most one apart. Null sources are a source of their
    own, repeated rows and rows without doc_id are dealt like others, and no rows give no rows."""
    return shards(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        before, docs = docs, written(made, name)
        if k:
            # the rows of the stage before, which this one's result holds by now
            dropped(before)
    return docs


def _over(sql: str, rows: str) -> str:
    """The SQL of a query over documents, over other rows with their columns instead."""
    return sql.replace("FROM documents", f"FROM {rows}")


#: For documents with distinct ids, which the tables of the driver have.
ORACLE_SQL = f"""
WITH good AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({OP8_SQL}) WHERE kept)),
single AS MATERIALIZED (SELECT * FROM good WHERE doc_id IN (SELECT doc_id FROM ({near_sql(5, "good")}) WHERE kept)),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id IN (SELECT doc_id FROM ({_over(OP2_SQL, "single")}) WHERE NOT contaminated)),
times AS (SELECT doc_id, CASE WHEN size > 0 THEN ceil(taken / size) ELSE 0 END AS times FROM ({_over(OP5_SQL, "clean")})),
mixed AS MATERIALIZED (SELECT {", ".join(COLUMNS)} FROM (SELECT clean.*, unnest(range(CAST(times AS BIGINT))) AS copy FROM clean JOIN times USING (doc_id)))
{shard_sql("mixed", ", ".join(COLUMNS))}
"""
