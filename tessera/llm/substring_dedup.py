"""Removal of repeated byte strings with run-length indexes over the repetitive part of a corpus.

1. Every window of LENGTH bytes belongs to its anchor: the leftmost of its K-byte strings with the least hash. Equal
   windows have equal anchors at equal places, so a window's repeats are all among the windows of that anchor string.
   The windows of one anchor occurrence are neighbours; their bytes are its fragment.
2. Anchors and fragments are counted by hash. A fragment that occurs twice is repeated as a whole. An anchor string
   that occurs once has no repeated window, and its fragments go no further: only repetitive text does.
3. The distinct fragments of the other anchor strings are cut out and gathered, whole groups at a time, into run-length
   indexes of bounded size. An index streams matching statistics over its fragments and marks every place that matches
   LENGTH bytes elsewhere. Each window is in one fragment only, so a match is another occurrence.
4. A group too large for one index is dealt anew: its fragments are cut into blocks of windows by their distance to the
   anchor, and blocks whose windows can match, as they share the bytes common to all windows of the block, make smaller
   groups, which have indexes of their own. Groups that are still too large are dealt by smaller blocks, down to one
   window, so that no group of any size is gathered and every undecided match is decided by an index.
5. Marked windows become byte ranges of documents; their union is removed.

Passages of more than PASSAGE_WORDS words that stand in several documents can be shorter than LENGTH bytes; they are
reported but not removed (see shared_passages).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, prepare, small, table, text_key, written
from .runindex import RunLengthIndex
from .textkit import Rolling, Spans, U, mix, pieces, words

LENGTH = 400
K = 64
#: Bytes of fragments of one index, and of the largest group that goes into one.
INDEX_BYTES = 1 << 20
#: Bytes of a text that are searched for anchors at once; places take the low bits of a hash.
PART = 1 << 20
#: Numbers of windows of the blocks that large groups are dealt by.
BLOCKS = (64, 8, 1)
#: Words that a shared passage has more than, and words of the strings that choose its anchors.
PASSAGE_WORDS, ANCHOR_WORDS = 50, 8
_PLACE_BITS = 22


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring keys."""
    done, out = 1, keys
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def fragments(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, fragment hash) of every fragment of the rows in buf."""
    n = len(buf) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    hashes = Rolling(buf)(k)
    keys = (hashes & ~U((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=U)
    anchor = (_least(keys, length - k + 1) & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    valid = np.arange(n) + length <= offsets[row + 1]
    where = np.flatnonzero(valid)
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    a, r = anchor[where], row[where]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (where[1:] != where[:-1] + 1)) + 1
    lo, hi = where[np.concatenate([[0], cut])], where[np.concatenate([cut - 1, [len(where) - 1]])]
    return row[lo], lo - offsets[row[lo]], hi - offsets[row[lo]], hashes[anchor[lo]], Spans(buf)(lo, hi + length)


OCCURRENCE = "doc_id long, tk long, anchor long, fragment long, lo long, hi long"


def _occurrences(length: int, k: int):
    names = [x.split()[0] for x in OCCURRENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = batch.column(0), batch.column(1)
            for a, b, buf, offsets in pieces(batch.column(2)):
                for at in range(0, max(len(buf) - length + 1, 1), PART):
                    # a longer row is searched in parts that share length - 1 bytes
                    part, offs = (buf, offsets) if b - a > 1 or len(buf) <= PART + length else (buf[at : at + PART + length - 1], np.array([0, min(len(buf) - at, PART + length - 1)]))
                    row, lo, hi, anchor, fragment = fragments(part, offs, length, k)
                    if len(row):
                        shift = at if part is not buf else 0
                        take = pa.array(row + a)
                        yield pa.RecordBatch.from_arrays([ids.take(take), tks.take(take), pa.array(anchor.view(np.int64)), pa.array(fragment.view(np.int64)), pa.array(lo + shift), pa.array(hi + shift)], names=names)
                    if part is buf:
                        break

    return run


CUT = "anchor long, fragment long, n long, hot boolean, doc_id long, tk long, lo long, bytes binary"


def _cut(length: int):
    """Cuts the fragments that a row's list names out of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer().to_pybytes()
                found = batch.column("cuts")[i].as_py()
                rows = [(c["anchor"], c["fragment"], c["n"], c["hot"], batch.column("doc_id")[i].as_py(), batch.column("tk")[i].as_py(), c["lo"], text[c["lo"] : c["hi"] + length]) for c in found]
                types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(x, types[f.split()[1]]) for x, f in zip(zip(*rows, strict=True), CUT.split(", "), strict=True)], names=[f.split()[0] for f in CUT.split(", ")])

    return run


RANGE = "doc_id long, tk long, a long, b long"


def _indexed(length: int):
    """Ranges of the fragments that occur once, from indexes over runs of whole anchor groups; rows come by anchor."""

    def ranges(rows: list[tuple]) -> pa.RecordBatch | None:
        if all(r[2] > 1 for r in rows) or len(rows) < 2:
            return None
        marked = RunLengthIndex([r[6] for r in rows]).repeated_starts(length)
        found = [(r[3], r[4], r[5] + e[k], r[5] + e[k + 1] - 1 + length) for r, e in zip(rows, marked, strict=True) if r[2] == 1 for k in range(0, len(e), 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[x.split()[0] for x in RANGE.split(", ")]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "fragment", "n", "doc_id", "tk", "lo", "bytes")), strict=True):
                if size > INDEX_BYTES // 2 and held[-1][0] != r[0]:
                    if (found := ranges(held)) is not None:
                        yield found
                    held, size = [], 0
                held.append(r)
                size += len(r[6]) + 1
        if held and (found := ranges(held)) is not None:
            yield found

    return run


NODE = "anchor long, fragment long, n long, doc_id long, tk long, low long, a long, b long, near long, far long, core long, span long"


def _anchored(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, int, int, int]]:
    """(row, bytes of the rows around it, its begin and end, place of its anchor) of every fragment of a batch."""
    keys = batch.column("anchor").to_numpy().view(U)
    for x, y, buf, offsets in pieces(batch.column("bytes")):
        grams = Rolling(buf)(k)
        for i in range(x, y):
            begin, end = int(offsets[i - x]), int(offsets[i - x + 1])
            yield i, buf, begin, end, begin + int(np.flatnonzero(grams[begin : end - k + 1] == keys[i])[0])


def _blocks(size: int, length: int, k: int):
    """Blocks of `size` neighbouring windows of fragments, by their distance to the anchor.

    low is the block's first distance; core hashes what all windows of a whole block share, and span all bytes of
    those that the fragment has, at distances near to far: bytes [a, b) of the document. Rows have the blocks of the
    level above (of `within` windows, with the times that they occur) that are still open, or null for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_doc, within, counted = batch.column("lo").to_numpy(), batch.column("within").to_numpy(), batch.column("n").to_numpy()
            held: dict[int, list[tuple[np.ndarray, ...]]] = {}
            buffers: dict[int, np.ndarray] = {}
            for i, buf, begin, end, place in _anchored(batch, k):
                least, most = place - begin - (end - begin - length), place - begin
                opened = batch.column("open")[i].as_py()
                if opened is None:
                    lows = np.arange(least // size * size, most + 1, size)
                    times = np.full(len(lows), counted[i])
                else:
                    lows = np.concatenate([np.arange(o["low"], o["low"] + within[i], size) for o in opened])
                    times = np.repeat([o["times"] for o in opened], -(-within[i] // size))
                ok = (lows + size > least) & (lows <= most)
                lows, times = lows[ok], times[ok]
                one = lambda v, n=len(lows): np.full(n, v)
                held.setdefault(id(buf), []).append((one(i), lows, np.maximum(lows, least), np.minimum(lows + size - 1, most), one(place), one(begin), times))
                buffers[id(buf)] = buf
            for key, parts in held.items():
                rows, low, near, far, place, begin, times = map(np.concatenate, zip(*parts, strict=True))
                spans = Spans(buffers[key])
                core = spans(place - low, place - low - size + 1 + length)
                span = spans(place - far, place - near + length)
                shift = at_doc[rows] - begin + place
                take = pa.array(rows)
                own = {c: batch.column(c).take(take) for c in ("anchor", "fragment", "doc_id", "tk")}
                columns = [own["anchor"], own["fragment"], times, own["doc_id"], own["tk"], low, shift - far, shift - near + length, near, far, core.view(np.int64), span.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])

    return run


def _block_cut(size: int, length: int, k: int):
    """The bytes of the blocks that a row's list gives to an index, as fragments of the groups that share a core."""
    names, types = [f.split()[0] for f in CUT.split(", ")], {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_doc, rows = batch.column("lo").to_numpy(), []
            for i, buf, begin, end, place in _anchored(batch, k):
                least, most = place - begin - (end - begin - length), place - begin
                for o in batch.column("open")[i].as_py():
                    if not o["large"]:
                        near, far = max(o["low"], least), min(o["low"] + size - 1, most)
                        a, b = place - far, place - near + length
                        rows.append((o["deal"], o["low"], o["times"], False, batch.column("doc_id")[i].as_py(), batch.column("tk")[i].as_py(), int(at_doc[i]) + a - begin, buf[a:b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, types[f.split()[1]]) for x, f in zip(zip(*rows, strict=True), CUT.split(", "), strict=True)], names=names)

    return run


def _by_index(cut: DataFrame, length: int) -> DataFrame:
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_indexed(length), RANGE)


def _dealt(hot: DataFrame, length: int, k: int, index_bytes: int) -> DataFrame:
    """Ranges of the fragments of large groups that occur once.

    A block whose span occurs twice is repeated as a whole. Blocks that share their core make a group: one without any
    other span has nothing left to decide, one of at most index_bytes goes into an index, and the blocks of larger ones
    are cut into smaller blocks, down to single windows, whose core is their span. One row stands for equal blocks.
    """
    names = ("anchor", "fragment", "n", "doc_id", "tk", "lo", "bytes")
    level, found = hot.select(*names, F.lit(None).cast("array<struct<low:long,times:long>>").alias("open"), F.lit(0).cast("long").alias("within")), None
    for size in BLOCKS:
        nodes = written(level.mapInArrow(_blocks(size, length, k), NODE), "blocks")
        same = ["anchor", "low", "near", "far", "span"]
        kinds = written(nodes.groupBy(*same, "core").agg(F.sum("n").alias("times"), F.min("fragment").alias("fragment")), "kinds")
        own = nodes.where("n = 1").join(kinds.where("times > 1").select(*same).hint("shuffle_merge"), same, "left_semi").select("doc_id", "tk", "a", "b")
        found = own if found is None else found.unionByName(own)
        cores = kinds.groupBy("anchor", "low", "core").agg(F.count("*").alias("kinds"), F.max(F.col("times") == 1).alias("unsure"), F.sum(F.col("far") - F.col("near") + length + 1).alias("bytes")).where("kinds > 1 and unsure")
        left = kinds.join(cores.hint("shuffle_merge"), ["anchor", "low", "core"])
        entry = F.struct("low", "times", (F.col("bytes") > index_bytes).alias("large"), F.xxhash64("anchor", "low", "core").alias("deal"))
        # one row for a fragment, of at most as many blocks as it has
        left = left.select("anchor", "fragment", entry.alias("e")).groupBy("anchor", "fragment").agg(F.collect_list("e").alias("open"))
        left = written(hot.select(*names).join(left.hint("shuffle_merge"), ["anchor", "fragment"]).select(*names, "open"), "open")
        found = found.unionByName(_by_index(left.mapInArrow(_block_cut(size, length, k), CUT), length))
        level = left.withColumn("open", F.expr("transform(filter(open, o -> o.large), o -> struct(o.low, o.times))")).where("size(open) > 0").withColumn("within", F.lit(size).cast("long"))
        if level.isEmpty():
            break
    return found


PASSAGE = "d long, anchor long, fragment long, first long, n long"


def _passages(words_most: int, k: int, listed: bool):
    """Runs of windows of words_most + 1 words with one anchor: the hashes of the anchor and of the run's words.

    The first window's first word and the number of windows place a run in its text. With `listed`, each row of the
    input names the runs, and each window of them makes a row (d, anchor, window) with the hash of its words.
    """
    size = words_most + 1
    multiply = U(0x9E3779B97F4A7C15)

    def rolled(h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all strings of n words, from those of 1, 2, 4, ... words."""
        m = max(len(h) - n + 1, 0)
        out, level, width, at = None, h, 1, 0
        while n and m:
            if n & 1:
                part = level[at : at + m]
                out, at = part if out is None else mix(out * multiply + part), at + width
            n >>= 1
            if n:
                level, width = mix(level[:-width] * multiply + level[width:]), 2 * width
        return np.zeros(0, U) if out is None else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for a, b, buf, offsets in pieces(batch.column("text")):
                start, end, first = words(buf, offsets)
                if len(start) < size:
                    continue
                h = Spans(buf)(start, end)
                windows = rolled(h, size)
                if listed:
                    for i in range(a, b):
                        cuts = batch.column("runs")[i].as_py()
                        at = [np.arange(c["first"], c["first"] + c["n"]) + first[i - a] for c in cuts]
                        anchor = np.repeat(np.array([c["anchor"] for c in cuts], np.int64), [len(x) for x in at])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchor), ids[i])), pa.array(anchor), pa.array(windows[np.concatenate(at)].view(np.int64))], names=["d", "anchor", "window"])
                    continue
                grams = rolled(h, k)
                for at in range(0, len(windows), 1 << _PLACE_BITS - 1):
                    part = grams[at : at + (1 << _PLACE_BITS - 1) + size - k]
                    keys = (part & ~U((1 << _PLACE_BITS) - 1)) | np.arange(len(part), dtype=U)
                    anchor = (_least(keys, size - k + 1) & U((1 << _PLACE_BITS) - 1)).astype(np.int64) + at
                    window = np.arange(at, at + len(anchor))
                    row = np.searchsorted(first, window, "right") - 1
                    ok = window + size <= first[row + 1]
                    if not ok.any():
                        continue
                    window, anchor, row = window[ok], anchor[ok], row[ok]
                    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)) + 1
                    lo, hi = window[np.concatenate([[0], cut])], window[np.concatenate([cut - 1, [len(window) - 1]])]
                    r, where = row[np.concatenate([[0], cut])], anchor[np.concatenate([[0], cut])]
                    fragment = mix(windows[lo] * multiply + mix(windows[hi] + (hi - lo).astype(U)))
                    columns = (ids[r + a], grams[where].view(np.int64), fragment.view(np.int64), lo - first[r], hi - lo + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in PASSAGE.split(", ")])

    return run


def shared_passages(texts: DataFrame, words_most: int = PASSAGE_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(d) of the texts (d, text) that share a run of more than words_most words with one of another d.

    Every window of words_most + 1 words belongs to the run of windows that share its anchor, the leftmost of its
    k-word strings with the least hash. Runs are counted by anchor: those of anchors in one text have nothing to share,
    and runs that stand in two texts as a whole decide both. Of the other runs the single windows are counted.
    """
    runs = written(texts.mapInArrow(_passages(words_most, k, False), PASSAGE), "passages")
    anchors = written(runs.groupBy("anchor").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x < y").select("anchor"), "passage-anchors")
    met = written(runs.join(small(anchors, anchors.count()), "anchor"), "met")
    dropped(runs)
    # one text stands for all that have a run
    kinds = written(met.groupBy("anchor", "fragment").agg(F.min(F.struct("d", "first", "n")).alias("rep"), F.max("d").alias("most")), "passage-kinds")
    whole = kinds.where("rep.d < most").select("anchor", "fragment")
    sure = written(met.join(whole.hint("shuffle_merge"), ["anchor", "fragment"], "left_semi").select("d").distinct(), "sure")
    # anchors of undecided texts, and the runs that share them
    unsure = written(met.join(small(sure, sure.count()), "d", "left_anti").select("anchor").distinct(), "unsure")
    named = kinds.join(small(unsure, unsure.count()), "anchor", "left_semi").select("rep.d", F.struct("anchor", "rep.first", "rep.n").alias("run"))
    wanted = named.select("d").distinct()
    # one row for a text, of at most as many runs as it has
    named = named.groupBy("d").agg(F.collect_list("run").alias("runs"))
    read = texts.join(small(wanted, wanted.count()), "d", "left_semi").join(named.hint("shuffle_merge"), "d")
    windows = written(read.mapInArrow(_passages(words_most, k, True), "d long, anchor long, window long"), "passage-windows")
    twice = windows.groupBy("anchor", "window").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("anchor", "window")
    return sure.unionByName(windows.join(twice.hint("shuffle_merge"), ["anchor", "window"], "left_semi").select("d")).distinct()


def _kept(n_keep: int):
    """Sizes, hash and bytes of what the ranges leave, between the kept columns and the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                value = batch.column("text")[i]
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                ranges = batch.column("ranges")[i].as_py() or []
                spans: list[list[int]] = []
                for r in sorted((r["a"], r["b"]) for r in ranges):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append([*r])
                left, at = [], 0
                for a, b in spans:
                    left.append(text[at:a])
                    at = b
                left = b"".join([*left, text[at:]])
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *columns, batch.column("shared_passage")], names=[*batch.schema.names[:n_keep], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "shared_passage"])

    return run


def repeats_removed(docs: DataFrame, length: int = LENGTH, k: int = K, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, shared_passage) of every row of docs (doc_id, text, ...).

    Every byte inside a string of `length` bytes that also starts anywhere else, in the same document or another, is
    removed; null texts are empty. shared_passage tells whether a run of more than PASSAGE_WORDS words, of whatever
    length in bytes, also stands in a document of another id or text; it removes nothing. Rows that repeat each other repeat all their strings. A null doc_id is a document
    like any other. Texts shorter than `length` lose nothing. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    occ = written(rows.mapInArrow(_occurrences(length, k), OCCURRENCE), "occurrences")
    groups = occ.groupBy("anchor", "fragment").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "lo", "hi")).alias("rep"))
    anchors = groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("occurrences"), F.sum(F.col("rep.hi") - F.col("rep.lo") + length + 1).alias("size")).where("occurrences > 1").drop("occurrences")
    groups = written(groups.join(anchors.hint("shuffle_merge"), "anchor"), "groups")

    whole = occ.join(groups.where("n > 1").select("anchor", "fragment").hint("shuffle_merge"), ["anchor", "fragment"]).select("doc_id", "tk", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    mixed = groups.where("kinds > 1").select("rep.doc_id", "rep.tk", F.struct("anchor", "fragment", "n", (F.col("size") > index_bytes).alias("hot"), "rep.lo", "rep.hi").alias("cut"))
    # one row for a document, of at most as many fragments as it has
    cuts = mixed.groupBy("doc_id", "tk").agg(F.collect_list("cut").alias("cuts")).withColumnsRenamed({"doc_id": "c_id", "tk": "c_tk"})
    wanted = mixed.select(F.col("doc_id").alias("w_id"), F.col("tk").alias("w_tk")).distinct()
    texts = rows.join(small(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tk") == F.col("w_tk")), "left_semi")
    cut = texts.join(cuts.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tk") == F.col("c_tk"))).select("doc_id", "tk", "text", "cuts").mapInArrow(_cut(length), CUT)
    # rows that repeat a document would cut its fragments again
    cut = written(cut.dropDuplicates(["anchor", "fragment"]), "fragments")
    hot = cut.where("hot")
    ranges = whole.unionByName(_by_index(cut.where("not hot"), length))
    if not hot.isEmpty():
        ranges = ranges.unionByName(_dealt(hot, length, k, index_bytes))
    ranges = ranges.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("a", "b")).alias("ranges")).withColumnsRenamed({"doc_id": "r_id", "tk": "r_tk"})
    ranges = written(ranges, "ranges")
    for done in (occ, groups, cut):
        dropped(done)
    keyed = rows.withColumn("d", F.xxhash64("doc_id", "tk"))
    shared = shared_passages(keyed.select("d", "text")).withColumn("shared", F.lit(True))
    marks = ranges.withColumn("d", F.xxhash64("r_id", "r_tk")).join(shared.hint("shuffle_merge"), "d", "full_outer").withColumnRenamed("d", "r_d")
    own = F.col("r_tk").isNull() | (F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tk") == F.col("r_tk")))
    out = keyed.join(marks.hint("shuffle_merge"), (F.col("d") == F.col("r_d")) & own, "left")
    out = out.select("doc_id", "text", "ranges", F.coalesce("shared", F.lit(False)).alias("shared_passage"))
    return out.mapInArrow(_kept(1), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, shared_passage boolean")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents")).drop("kept_bytes")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS nb FROM documents),
win AS (SELECT r, s, md5(h[2 * s + 1 : 2 * s + 800]) AS m FROM (SELECT r, h, unnest(range(0, nb - 399)) AS s FROM d WHERE nb >= 400)),
rep AS (SELECT r, s FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n FROM win) WHERE n > 1),
cut AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM rep),
spans AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM cut) GROUP BY r, g),
left_over AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS begin FROM spans),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(h[2 * begin + 1 : 2 * a], '' ORDER BY a) AS head FROM left_over JOIN d USING (r) GROUP BY r),
w AS (SELECT md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text) AS key, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
pw AS (SELECT key, md5(array_to_string(w[i : i + 50], ' ')) AS m FROM (SELECT key, w, unnest(range(1, len(w) - 49)) AS i FROM w WHERE len(w) > 50)),
sp AS (SELECT DISTINCT key FROM pw JOIN (SELECT m FROM pw GROUP BY m HAVING min(key) < max(key)) USING (m))
SELECT doc_id, CAST(nb AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN gone.r IS NULL THEN h ELSE head || h[2 * last + 1 :] END)) AS kept_sha256, sp.key IS NOT NULL AS shared_passage
FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN sp ON sp.key = md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text)
"""
