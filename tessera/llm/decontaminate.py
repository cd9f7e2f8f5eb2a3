"""Benchmark decontamination by winnowing, in DataFrame code.

A window is WINDOW consecutive words of a benchmark item. Both sides keep winnowed fingerprints: of every GUARD
neighbouring k-gram hashes (GUARD = WINDOW - K + 1) the least one, so any shared span of WINDOW words shares one. The
fingerprints of both sides are joined; documents with a match are read again, their k-grams are joined with the items'
fingerprints, every place found is extended to the windows that hold it, and these are joined with the items' windows by
their words.
Items of fewer than WINDOW words are one window each; for the lengths that occur, documents are fingerprinted by their
n-grams of that length, which makes the guarantee hold for them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, text_key, written

WINDOW = 10
K = 5
GUARD = WINDOW - K + 1
_SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_list(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after lower-casing A-Z; empty for null."""
    spaced = F.translate(text, _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def _grams(n: int) -> str:
    """Hashes of the n-grams of the word hashes h, by first word."""
    return f"transform(sequence(1, greatest(size(h) - {n - 1}, 1)), i -> xxhash64({', '.join(f'element_at(h, i + {k})' for k in range(n))}))"


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))


def _winnowed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (words, ...) with fps: the winnowed k-gram hashes and the n-gram hashes of the short lengths."""
    rows = _hashed(rows).withColumn("g", F.expr(f"if(size(h) >= {K}, {_grams(K)}, array())").cast("array<bigint>"))
    fps = F.expr(f"if(size(g) >= {GUARD}, transform(sequence(1, greatest(size(g) - {GUARD - 1}, 1)), i -> array_min(slice(g, i, {GUARD}))), array())").cast("array<bigint>")
    for n in lengths:
        fps = F.concat(fps, F.expr(f"if(size(h) >= {n}, {_grams(n)}, array())").cast("array<bigint>"))
    return rows.withColumn("fps", F.array_distinct(fps)).drop("h", "g")


def _places(rows: DataFrame, n: int, fps: DataFrame) -> DataFrame:
    """(doc_id, tk, at): 1-based places of the n-grams of rows (doc_id, tk, words) that are among the fingerprints."""
    grams = _hashed(rows).select("doc_id", "tk", F.explode(F.expr(f"if(size(h) >= {n}, transform({_grams(n)}, (x, i) -> struct(x as fp, i + 1 as at)), array())").cast("array<struct<fp:bigint,at:int>>")).alias("g"))
    return grams.select("doc_id", "tk", "g.fp", "g.at").join(fps, "fp").select("doc_id", "tk", "at")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tk, n_words, n_hit, n_items, items, contaminated) of every row of docs (doc_id, text, ...).

    benchmark has item_id and text. n_hit counts the words inside any occurrence of a window of an item, items is the
    array of the items with an occurring window, as strings in order, tk the text_key of the row. Null texts have no words on either side; items
    without words have no window; a null item_id is the string null. Items that repeat an item_id count once. Rows that
    repeat a doc_id are judged by their own text. Other columns are ignored. Without documents there are no rows, and
    without items nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), word_list(F.col("text")).alias("words")).where(F.size("words") > 0)
    # few rows, but much work for each
    items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    item_windows = items.withColumn("n", F.least(F.size("words"), F.lit(WINDOW))).select("item", "n", F.explode(F.expr("transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))")).alias("window"))
    item_windows = written(item_windows.distinct(), "windows")
    # at most WINDOW - 1 numbers
    lengths = sorted(r[0] for r in item_windows.where(F.col("n") < WINDOW).select("n").distinct().collect())
    long_fps = _winnowed(items.where(F.size("words") >= WINDOW), []).select(F.explode("fps").alias("fp"))
    short_fps = [_hashed(items.where(F.size("words") == n)).select(F.expr(_grams(n) + "[0]").alias("fp")) for n in lengths]
    fps = long_fps
    for s in short_fps:
        fps = fps.unionByName(s)
    fps = written(fps.distinct(), "item-fps")

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = _winnowed(ids.select("doc_id", text_key().alias("tk"), word_list(F.col("text")).alias("words")), lengths)
    base = written(base.select("doc_id", "tk", F.size("words").cast("long").alias("n_words"), "fps"), "doc-fps")
    fps = small(fps, fps.count())
    hit_docs = written(base.select("doc_id", "tk", F.explode("fps").alias("fp")).join(fps, "fp").select(F.col("doc_id").alias("m_id"), F.col("tk").alias("m_tk")).distinct(), "matched")
    found = ids.withColumn("tk", text_key()).join(small(hit_docs, hit_docs.count()), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tk") == F.col("m_tk")), "left_semi")
    # rows of one doc_id and one text have the same windows
    found = written(found.select("doc_id", "tk", word_list(F.col("text")).alias("words")), "hit-words").dropDuplicates(["doc_id", "tk"])
    reach = F.expr(f"if(size(words) >= {WINDOW}, flatten(transform(at, x -> sequence(greatest(x - {WINDOW - K}, 1), greatest(least(x, size(words) - {WINDOW - 1}), greatest(x - {WINDOW - K}, 1))))), array())")
    starts = None
    for n in [WINDOW, *lengths]:
        # one row for a document, of at most as many places as it has words
        at = _places(found, K if n == WINDOW else n, fps).groupBy(F.col("doc_id").alias("a_id"), F.col("tk").alias("a_tk")).agg(F.collect_set("at").alias("at"))
        own = found.join(at.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("tk") == F.col("a_tk")))
        own = own.withColumn("s", F.array_distinct(reach.cast("array<int>")) if n == WINDOW else F.col("at"))
        cut = F.explode(F.expr(f"transform(filter(s, x -> x + {n - 1} <= size(words)), x -> struct(x as s, array_join(slice(words, x, {n}), ' ') as window))"))
        own = own.select("doc_id", "tk", cut.alias("w")).select("doc_id", "tk", "w.s", F.lit(n).alias("n"), "w.window")
        starts = own if starts is None else starts.unionByName(own)
    # a window is a string of at most WINDOW words, which may be long
    measure = item_windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    held = starts.join(small(item_windows, measure["rows"] * 16 + measure["bytes"], 1), ["window", "n"]).select("doc_id", "tk", "s", "n", "item")
    held = written(held, "occurrences")

    in_doc = W.partitionBy("doc_id", "tk").orderBy("s", "n").rowsBetween(W.unboundedPreceding, -1)
    spans = held.groupBy("doc_id", "tk", "s").agg(F.max("n").alias("n")).withColumn("covered", F.coalesce(F.max(F.col("s") + F.col("n")).over(in_doc), F.lit(0)))
    hit = spans.groupBy("doc_id", "tk").agg(F.sum(F.greatest(F.lit(0), F.col("s") + F.col("n") - F.greatest("s", "covered"))).cast("long").alias("n_hit"))
    named = held.select("doc_id", "tk", "item").distinct().groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = hit.join(named.withColumnsRenamed({"doc_id": "i_id", "tk": "i_tk"}), F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("tk") == F.col("i_tk"))).select(F.col("doc_id").alias("m_id"), F.col("tk").alias("m_tk"), "n_hit", "items")
    out = base.select("doc_id", "tk", "n_words").join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tk") == F.col("m_tk")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "tk", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (n_hit > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
o AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (win, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id IS NOT DISTINCT FROM h.doc_id LEFT JOIN m ON d.doc_id IS NOT DISTINCT FROM m.doc_id
"""
