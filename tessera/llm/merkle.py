"""A Merkle manifest of a dataset, with proofs by the preimages of a leaf's ancestors.

A node's preimage is the concatenated hashes of its children, FAN of them at most, and its hash is the preimage's sha256.
Trees grow in rounds: nodes that follow one another are gathered FAN ** DEPTH at a time into a block, which holds all its
preimages by level and gives one node to the next round, so a round shuffles its nodes once and no group outgrows a
block. The blocks are the manifest. Going down, a block gets the path of its top node (what stands left and right of the
node's own 64 characters in every ancestor's preimage); a leaf then joins its block, cuts its own slot out of the preimages
for its siblings, and puts another hash into the slot to fold it up to a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, small, table, written

FAN = 3
#: Levels of a block, which so holds FAN ** DEPTH nodes of a round at most.
DEPTH = 6
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def sha(preimage: Column) -> Column:
    return F.sha2(preimage.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: - for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The hash of a row of FIELDS, with another text if given."""
    return sha(F.concat(*[field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]))


def _numbered(rows: DataFrame, group: str | None, order: list[Column], name: str) -> DataFrame:
    """rows with m_pos, the place from 0 in the group's order (or in the order of all), and m_n, the rows of the group.

    Rows are dealt into ranges of the order and sorted there; the rows of each range and group are counted, and the sums
    of the ranges before give the offset of a range. Equal rows are dealt at random, so they may share any number of ranges.
    """
    key = [F.col(group).asc_nulls_first()] if group else []
    salted = rows.withColumn("m_salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(*key, *order, "m_salt").sortWithinPartitions(*key, *order, "m_salt")
    ranged = written(ranged.drop("m_salt").withColumn("m_id", F.monotonically_increasing_id()), name)
    own = F.col(group) if group else F.lit(0)
    parts = ranged.groupBy(own.alias("m_own"), F.shiftright("m_id", 33).alias("m_part")).agg(F.min("m_id").alias("m_first"), F.count("*").alias("m_rows"))
    # a row for each range that holds rows of the group
    whole = W.partitionBy("m_own")
    before = F.coalesce(F.sum("m_rows").over(whole.orderBy("m_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = written(parts.select("m_own", "m_part", (before - F.col("m_first")).alias("m_shift"), F.sum("m_rows").over(whole).alias("m_n")), f"{name}-ranges")
    found = ranged.join(small(parts, parts.count(), 64), own.eqNullSafe(F.col("m_own")) & (F.shiftright("m_id", 33) == F.col("m_part")))
    return found.withColumn("m_pos", F.col("m_shift") + F.col("m_id")).drop("m_own", "m_part", "m_shift", "m_id")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, preimages by level, top) of the nodes (tree, n, pos, hash) of a round; a tree's levels end at its one node."""
    block = F.floor(F.col("pos") / FAN**DEPTH).cast("long")
    out = nodes.groupBy("tree", "n", block.alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h0"))
    for k in range(DEPTH):
        joined = F.expr(f"transform(sequence(0, cast((size(h{k}) - 1) div {FAN} as int)), i -> array_join(slice(h{k}, i * {FAN} + 1, {FAN}), ''))")
        out = out.withColumn(f"p{k}", F.when(F.col("n") > FAN**k, joined).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"h{k + 1}", F.when(F.col("n") > FAN**k, F.transform(f"p{k}", sha)).otherwise(F.col(f"h{k}")))
    return out.select("tree", "n", "block", F.array(*[f"p{k}" for k in range(DEPTH)]).alias("preimages"), F.element_at(f"h{DEPTH}", 1).alias("top"))


def _climbed(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of all rounds, from the leaves up; each is written. A tree that has come to one node is left behind."""
    rounds = []
    while True:
        rounds.append(written(_blocks(nodes), name))
        more = rounds[-1].where(F.col("n") > FAN**DEPTH)
        if more.isEmpty():
            return rounds
        nodes = more.select("tree", F.ceil(F.col("n") / FAN**DEPTH).cast("long").alias("n"), F.col("block").alias("pos"), F.col("top").alias("hash"))


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top) of every tree."""
    out = None
    for blocks in rounds:
        one = blocks.where(F.col("n") <= FAN**DEPTH).select("tree", "top")
        out = one if out is None else out.unionByName(one)
    return out


def _slots(pos: Column, preimages: Column) -> list[tuple[Column, Column, Column]]:
    """(whether there is one, left, right) of a node's ancestor on each level of its block, without the node's own slot."""
    out = []
    for k in range(DEPTH):
        preimage = F.get(F.get(preimages, k), F.pmod(F.floor(pos / FAN ** (k + 1)), F.lit(FAN ** (DEPTH - k - 1))).cast("int"))
        at = F.pmod(F.floor(pos / FAN**k), F.lit(FAN)).cast("int") * DIGEST
        out.append((preimage.isNotNull(), F.substring(preimage, F.lit(1), at), F.substring(preimage, at + DIGEST + 1, F.lit(FAN * DIGEST))))
    return out


def _path(pos: Column, preimages: Column, above: Column) -> Column:
    """What stands left and right of a node in the preimages of its ancestors, from its block up."""
    own = F.array_compact(F.array(*[F.when(there, F.struct(left.alias("left"), right.alias("right"))) for there, left, right in _slots(pos, preimages)]))
    return F.concat(own, above)


def _down(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The blocks of the lowest round with `above`, the path of their top; tops (tree, above) has that of a tree's root."""
    upper = None
    for blocks in reversed(rounds):
        done = blocks.where(F.col("n") <= FAN**DEPTH).join(tops.hint("shuffle_merge"), "tree").select(*blocks.columns, "above")
        if upper is not None:
            by = upper.select(F.col("tree").alias("u_tree"), F.col("block").alias("u_block"), F.col("preimages").alias("u_preimages"), F.col("above").alias("u_above"))
            lower = blocks.where(F.col("n") > FAN**DEPTH).join(by.hint("shuffle_merge"), (F.col("tree") == F.col("u_tree")) & (F.floor(F.col("block") / FAN**DEPTH) == F.col("u_block")))
            done = done.unionByName(lower.select(*blocks.columns, _path(F.col("block"), F.col("u_preimages"), F.col("u_above")).alias("above")))
        upper = written(done, name)
    return upper


def merkle(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each of docs (FIELDS): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by doc_id, null first, and rows with one doc_id by their hash; equal rows are leaves of their own.
    Subroots ascend by source, null first and bytewise. folded_root is folded from the leaf of `tampered`, a text that
    replaces the row's (null: the row's own leaf), with the siblings of the row. A source's only leaf is its subroot, an only
    subroot is the root, and then there are no siblings. Columns beside FIELDS are dropped. No rows give no rows.
    """
    made = docs.select("doc_id", F.col("source").alias("m_source"), leaf().alias("leaf"), (F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))).alias("other"))
    made = written(made.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "leaves")
    placed = _numbered(made, "m_source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "ordered-leaves")
    sources = _numbered(made.groupBy("m_source").agg(F.count("*").alias("s_rows")), None, [F.col("m_source").asc_nulls_first()], "ordered-sources")
    sources = written(sources.select(F.col("m_source").alias("s_source"), F.col("m_pos").alias("tree"), F.col("m_n").alias("trees")), "sources")
    placed = placed.join(small(sources, sources.count(), 64), F.col("m_source").eqNullSafe(F.col("s_source")))
    leaves = written(placed.select("tree", F.col("m_n").alias("n"), F.col("m_pos").alias("pos"), "doc_id", "leaf", "other"), "placed-leaves")
    dropped(made)
    rounds = _climbed(leaves.select("tree", "n", "pos", F.col("leaf").alias("hash")), "blocks")
    subroots = written(_tops(rounds).withColumnRenamed("top", "subroot"), "subroots")
    forest = _climbed(subroots.join(sources.select("tree", F.col("trees").alias("n")), "tree").select(F.lit(0).cast("long").alias("tree"), "n", F.col("tree").alias("pos"), F.col("subroot").alias("hash")), "forest")
    roots = written(_tops(forest), "root")
    upper = _down(forest, roots.select("tree", F.array().cast(_PATH).alias("above")), "forest-paths")
    in_block = F.floor(F.col("tree") / FAN**DEPTH) == F.col("block")
    by = upper.select("block", "preimages", F.col("above").alias("u_above"))
    tops = written(subroots.join(by.hint("shuffle_merge"), in_block).select("tree", "subroot", _path(F.col("tree"), F.col("preimages"), F.col("u_above")).alias("above")), "source-paths")
    lower = _down(rounds, tops.select("tree", "above"), "paths").select(F.col("tree").alias("b_tree"), "block", "preimages", "above")
    lower = lower.join(tops.select(F.col("tree").alias("t_tree"), "subroot").hint("shuffle_merge"), F.col("b_tree") == F.col("t_tree")).drop("t_tree")
    # one row
    root = F.broadcast(roots.select(F.col("top").alias("root")))
    rows = leaves.join(lower.hint("shuffle_merge"), (F.col("tree") == F.col("b_tree")) & (F.floor(F.col("pos") / FAN**DEPTH) == F.col("block"))).crossJoin(root)
    folded, siblings = F.coalesce("other", "leaf"), []
    for there, left, right in _slots(F.col("pos"), F.col("preimages")):
        folded = F.when(there, sha(F.concat(left, folded, right))).otherwise(folded)
        siblings.append(F.when(there, F.concat(left, right)))
    rows = rows.select("doc_id", "leaf", "subroot", "root", "above", folded.alias("m_folded"), F.concat_ws("", *siblings).alias("m_own"))
    proof = sha(F.concat(F.col("m_own"), F.array_join(F.transform("above", lambda x: F.concat(x["left"], x["right"])), "")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.aggregate("above", F.col("m_folded"), lambda h, x: sha(F.concat(x["left"], h, x["right"]))).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS b, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])) AS c FROM documents, crc),
f AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM d),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other FROM f),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree FROM l),
up AS (SELECT tree, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM o
  UNION ALL SELECT tree, lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, lv, n, pos // 3),
sub AS MATERIALIZED (SELECT tree, h AS subroot, lv AS depth FROM up WHERE n = 1),
fo AS (SELECT 0 AS lv, tree AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM fo WHERE n > 1 GROUP BY lv, n, pos // 3),
nodes AS MATERIALIZED (SELECT tree, lv, pos // 3 AS up, string_agg(h, '' ORDER BY pos) AS pre FROM up WHERE n > 1 GROUP BY tree, lv, pos // 3
  UNION ALL SELECT -1, lv, pos // 3, string_agg(h, '' ORDER BY pos) FROM fo WHERE n > 1 GROUP BY lv, pos // 3),
deep AS (SELECT (SELECT max(lv) FROM fo) AS fdepth, (SELECT h FROM fo WHERE n = 1) AS root),
fold AS (SELECT o.doc_id, o.tree, o.pos, leaf, subroot, root, depth, fdepth, 0 AS lv, other AS h, '' AS proof FROM o JOIN sub USING (tree), deep
  UNION ALL SELECT f.doc_id, f.tree, f.pos, leaf, subroot, root, depth, fdepth, f.lv + 1, sha256(left(pre, 64 * slot) || h || substr(pre, 64 * slot + 65)), proof || left(pre, 64 * slot) || substr(pre, 64 * slot + 65)
  FROM (SELECT *, CASE WHEN lv < depth THEN tree ELSE -1 END AS t, CASE WHEN lv < depth THEN lv ELSE lv - depth END AS l, CASE WHEN lv < depth THEN pos ELSE tree END // CAST(pow(3, CASE WHEN lv < depth THEN lv ELSE lv - depth END) AS BIGINT) AS p,
      (CASE WHEN lv < depth THEN pos ELSE tree END // CAST(pow(3, CASE WHEN lv < depth THEN lv ELSE lv - depth END) AS BIGINT)) % 3 AS slot FROM fold WHERE lv < depth + fdepth) f
  JOIN nodes ON nodes.tree = f.t AND nodes.lv = f.l AND nodes.up = f.p // 3)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM fold WHERE lv = depth + fdepth
"""
