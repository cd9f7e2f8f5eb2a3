"""Near-duplicate documents by HyperMinHash sketches, banding and confirmation on full shingle sets.

1. Every text becomes its set of 64-bit shingle hashes and a HyperMinHash sketch of 256 registers: the hash's top
   8 bits choose the bucket, and a bucket keeps the leading-zero count (6 bits) and the next 10 bits (mantissa) of
   its least remaining hash. An empty bucket takes the register of the filled bucket that is first in its own fixed
   random order, so that sets smaller than the sketch still agree in a share of registers near their similarity.
2. Rows with equal sets form one class (128-bit set hash); only one row for each class goes on.
3. The first 128 compressed registers make 32 bands of 4. Classes in a bucket meet the bucket's least document only
   (a star), so a bucket of n classes gives n - 1 candidates, never n * n.
4. Candidates pass if the collision-corrected Jaccard estimate of all registers is within six standard deviations of
   the threshold, and count as links if 100 * intersection >= 80 * union on their full sets.
5. Buckets that still hold several components are compared across components, in blocks of bounded size, inside a
   kernel that emits only pairs whose estimate and shingle sets pass. These are confirmed in the same way, so no link
   between components that share a bucket is lost. Two sets with similarity 0.8 share none of the 32 bands with a
   probability of 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, prepare, small, table, written
from .components import components
from .textkit import Spans, U, lowered, mix, pieces, words

BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
VALUE_BITS = 64 - BUCKET_BITS
MANTISSA_BITS = 10
BANDS, BAND_ROWS = 32, 4
SIGMAS = 6.0
#: Rows and shingles of the blocks that a bucket is cut into.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: The rank of each bucket in the order in which a bucket looks for a filled one: itself first.
_ORDER = np.argsort(np.argsort(np.random.default_rng(11).random((REGISTERS, REGISTERS)) - 2 * np.eye(REGISTERS), axis=1), axis=1).astype(np.uint8)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: shingles of `size` words, or the whole shorter sequence."""
    for a, b, buf, offsets in pieces(column):
        low = lowered(buf)
        start, end, first = words(low, offsets)
        hashes = Spans(low)(start, end)
        grams = [hashes[k : len(hashes) - size + 1 + k] for k in range(size)]
        rolled = np.zeros(max(len(hashes) - size + 1, 0), U)
        if len(rolled):
            for g in grams:
                rolled = mix(rolled * U(0x9E3779B97F4A7C15) + g)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= size:
                yield np.unique(rolled[first[i] : first[i] + n - size + 1])
            else:
                whole = np.zeros(min(n, 1), U)
                for h in hashes[first[i] : first[i + 1]]:
                    whole = mix(whole * U(0x9E3779B97F4A7C15) + h)
                yield whole


def registers(values: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (uint16) of a sorted, non-empty hash set."""
    bucket = (values >> U(VALUE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    v, filled = values[first] & U((1 << VALUE_BITS) - 1), bucket[first]
    length = np.zeros(len(v), np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        high = (v >> (length + k - 1).astype(U)) > U(0)
        length += np.where(high, k, 0)
    length = np.where(v >> length.astype(U) > U(0), length + 1, length)
    zeros = VALUE_BITS - length
    shift = length - 1 - MANTISSA_BITS
    mantissa = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(U), v << np.maximum(-shift, 0).astype(U)) & U((1 << MANTISSA_BITS) - 1)
    kept = (zeros.astype(np.uint16) << MANTISSA_BITS) | mantissa.astype(np.uint16)
    return kept if len(filled) == REGISTERS else kept[np.argmin(_ORDER[:, filled], axis=1)]


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less the registers expected to agree by chance."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = REGISTERS * 0.169919487159739093975315012348 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(agree - chance, 0) / (REGISTERS - chance)


def passes(agree: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate and the set sizes leave room for a similarity of percent / 100."""
    least, most = np.minimum(n, m), np.maximum(n, m)
    t = percent / 100
    slack = SIGMAS * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.maximum(least, 1)))
    return (100 * least >= percent * most) & (estimate(agree, n, m) >= t - slack)


SKETCH = "doc_id long, n_shingles long, c1 long, c2 long, sketch binary"


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, sig = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                spread = mix(s + U(0x632BE59BD9B4E019))
                c.append((spread.sum(dtype=U), mix(spread ^ s).sum(dtype=U)))
                sig.append(registers(s).tobytes() if len(s) else None)
            ids = np.array(c, U).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "c1", "c2", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, total = [], [], 0

            def flush():
                c = np.array(ids, U).reshape(-1, 2).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, U), *held]).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["c1", "c2", "shingles"])

            for s in shingle_sets(batch.column(1), size):
                spread = mix(s + U(0x632BE59BD9B4E019))
                ids.append((spread.sum(dtype=U), mix(spread ^ s).sum(dtype=U)))
                held.append(s)
                total += len(s)
                if total > 1 << 20:
                    yield flush()
                    held, ids, total = [], [], 0
            if held:
                yield flush()

    return run


def _fine(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c1, c2, shingles in ((b.column(0), b.column(1), b.column(2)) for b in _sets(size)(batches)):
            halves = [np.unique((x.values.to_numpy().view(U) >> U(32)).astype(np.uint32)).tobytes() for x in shingles]
            yield pa.RecordBatch.from_arrays([c1, c2, pa.array(halves, pa.binary())], names=["c1", "c2", "fine"])

    return run


def _bands(classes: DataFrame, *columns: str) -> DataFrame:
    """The columns with k and band for each band of each class: a band's key is its four registers and k, hashed."""
    width = 2 * BAND_ROWS
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)).alias("band")) for k in range(BANDS)])
    return classes.select(*columns, F.explode(keys).alias("e")).select(*columns, "e.k", "e.band")


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("sa", "sb"))
                ok = passes((a == b).sum(axis=1), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
                yield batch.filter(pa.array(ok)).select(["a1", "a2", "ra", "b1", "b2", "rb"])

    return run


PAIR = "a1 long, a2 long, ra long, b1 long, b2 long, rb long"


def _across(percent: int):
    """Pairs of one (band, i, j) block that lie in different components and are similar enough.

    Rows come sorted by block; a block has about 2 * BLOCK rows and 2 * BLOCK_SHINGLES shingles at most. Pairs whose
    estimate passes are compared by the upper halves of their shingle hashes, whose intersection is never too small. A pair that shares several bands comes from
    the first of them alone, and one that lies within a single half of the block from the block (i, i) alone.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        label, half, i, j = (rows.column(k).to_numpy() for k in ("label", "half", "i", "j"))
        names, counts = np.unique(label, return_counts=True)
        if len(names) == 1:
            return None
        sig = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        bands = np.ascontiguousarray(sig[:, : BANDS * BAND_ROWS]).view(np.uint64)
        n, k, same = rows.column("n_shingles").to_numpy(), rows.column("k").to_numpy()[0], i[0] == j[0]
        fine = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("fine")]
        odd = np.flatnonzero(label != names[np.argmax(counts)])
        rest = np.zeros(len(label), bool)
        rest[odd] = True
        x, y = [], []
        for r in odd:
            ok = (label != label[r]) & (~rest | (np.arange(len(label)) > r))
            if not same:
                ok &= half != half[r]
            to = np.flatnonzero(ok)
            to = to[passes((sig[to] == sig[r]).sum(axis=1), n[to], np.full(len(to), n[r]), percent)]
            to = to[np.argmax(bands[to] == bands[r], axis=1) == k] if len(to) else to
            common = np.array([(fine[t][np.minimum(np.searchsorted(fine[t], fine[r]), len(fine[t]) - 1)] == fine[r]).sum() for t in to], np.int64) + n[r] - len(fine[r])
            to = to[100 * common >= percent * (n[to] + n[r] - common)]
            x.append(np.full(len(to), r))
            y.append(to)
        x, y = np.concatenate(x), np.concatenate(y)
        ids = [rows.column(c).to_numpy() for c in ("c1", "c2", "rep")]
        return pa.RecordBatch.from_arrays([pa.array(c[x]) for c in ids] + [pa.array(c[y]) for c in ids], names=["a1", "a2", "ra", "b1", "b2", "rb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("band", "i", "j")):
                cuts = np.concatenate([[0], cuts])
            at = 0
            for c in cuts:
                held.append(batch.slice(at, c - at))
                if (found := pairs(pa.Table.from_batches(held))) is not None:
                    yield found
                held, at = [], c
            held.append(batch.slice(at))
        if held and (found := pairs(pa.Table.from_batches(held))) is not None:
            yield found

    return run


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of the candidate pairs of classes whose full sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("ra", "rb")).alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").select("doc_id", "text").join(small(wanted, wanted.count()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(size), "c1 long, c2 long, shingles array<long>").groupBy("c1", "c2").agg(F.first("shingles").alias("shingles"))
    left = sets.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("shingles").alias("sb"))
    both = pairs.join(right.hint("shuffle_merge"), ["b1", "b2"]).join(left.hint("shuffle_merge"), ["a1", "a2"])
    common = F.size(F.array_intersect("sa", "sb"))
    near = both.withColumn("common", common).where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("common")))
    return near.select(F.col("ra").alias("u"), F.col("rb").alias("v"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs, which has doc_id and text.

    Null or empty texts, or texts of white space, have an empty set and link with nothing. Rows that
    repeat a doc_id are judged each by its own text; texts with the same smallest doc_id are one node. A null doc_id is linked with nothing: its
    component is null and it is kept. Other columns, of whatever name, are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches(shingle_words), SKETCH), "sketches")
    classes = written(rows.where("doc_id is not null and n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    bands = _bands(classes, "c1", "c2", "rep")
    leader = bands.groupBy("band").agg(F.min(F.struct("rep", "c1", "c2")).alias("a"), F.count("*").alias("n")).where("n > 1").select("band", F.col("a.c1").alias("a1"), F.col("a.c2").alias("a2"), F.col("a.rep").alias("ra"))
    star = bands.join(leader.hint("shuffle_merge"), "band").select("a1", "a2", "ra", F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("rep").alias("rb")).where("a1 <> b1 or a2 <> b2").distinct()
    known = lambda p: classes.select(F.col("c1").alias(f"{p}1"), F.col("c2").alias(f"{p}2"), F.col("n_shingles").alias(f"n{p}"), F.col("sketch").alias(f"s{p}"))
    star = star.join(known("b").hint("shuffle_merge"), ["b1", "b2"]).join(known("a").hint("shuffle_merge"), ["a1", "a2"])
    star = written(star.mapInArrow(_estimated(percent), PAIR), "star")
    links = written(fitted(_links(star, docs, shingle_words, percent).distinct(), star.count()), "links")
    labels = components(links)

    labelled = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    labelled = written(labelled, "labelled")
    mixed = _bands(labelled, "label", "n_shingles").groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum("n_shingles").alias("words")).where("n > 2 and least < most")
    mixed = mixed.select("band", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = written(_bands(labelled, "c1", "c2", "rep").join(mixed.hint("shuffle_merge"), "band"), "mixed")
    wanted = member.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").join(small(wanted, wanted.count()), "doc_id", "left_semi")
    fine = texts.mapInArrow(_fine(shingle_words), "c1 long, c2 long, fine binary").groupBy("c1", "c2").agg(F.first("fine").alias("fine"))
    member = member.withColumn("half", F.expr("cast(pmod(xxhash64(c1, c2), blocks) as int)"))
    dealt = member.select("*", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, half) as i, greatest(x, half) as j))")).alias("ij")).select("c1", "c2", "k", "band", "half", "ij.i", "ij.j")
    dealt = dealt.join(labelled.select("c1", "c2", "rep", "n_shingles", "label", "sketch").hint("shuffle_merge"), ["c1", "c2"])
    dealt = dealt.join(fine.hint("shuffle_merge"), ["c1", "c2"])
    late = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across(percent), PAIR)
    late = written(late.distinct(), "across")
    if not late.isEmpty():
        more = written(fitted(_links(late, docs, shingle_words, percent).distinct(), late.count()), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    reps = classes.select("c1", "c2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("sketch").join(reps.hint("shuffle_merge"), ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def near_sql(shingle_words: int, table: str = "documents") -> str:
    """SQL of near_duplicates over the rows (doc_id, text) of a table with distinct doc_ids."""
    return _SQL.replace("$K", str(shingle_words)).replace("$T", table)


_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM $T),
l AS (SELECT doc_id, CASE WHEN len(w) >= $K THEN list_distinct(list_transform(range(1, len(w) - $K + 2), lambda i: array_to_string(w[i : i + $K - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
s AS (SELECT doc_id, unnest(g) AS g FROM l),
n AS (SELECT doc_id, len(g) AS n FROM l),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS src, x AS cur FROM f UNION SELECT r.src, f.y FROM r JOIN f ON f.x = r.cur),
k AS (SELECT src, min(cur) AS component_id FROM r GROUP BY src)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN k ON k.src = n.doc_id
"""
OP1_SQL = near_sql(2)
