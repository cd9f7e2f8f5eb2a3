"""URL filters by a cascade of Bloom filters.

Keys are listed hosts and the hosts and paths of rules. The key universe is every key that a url of the corpus could ask
for. Level 1 of the cascade encodes the listed keys, level 2 the unlisted keys of the universe that level 1 takes for
listed, level 3 the listed keys that level 2 takes for unlisted, and so on until a level takes nothing wrongly. A key
is then listed if the first level that denies it has an even number, which is exact for all keys of the universe, so a
url is judged by looking up bits, without any join of urls. Everything is DataFrame code.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, lower_ascii, table, written

#: (host, path, verdict); a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Hosts with one of these words in a label (labels are cut at hyphens) are listed.
TERMS = ("ads", "adult", "bets", "casino", "gambling", "loans", "pills", "porn", "sex", "spam", "xxx")
#: Words of a chunk (a power of two), and bytes of filters that one pass over the urls may hand to the tasks.
CHUNK_WORDS = 4096
FILTER_BYTES = 64_000_000
#: Times the bits of a plain Bloom filter, as a key's bits share a word.
ROOM = 1.3
#: A cascade that is deeper has two keys that agree in 128 bits of hashes, which is an error.
MAX_LEVELS = 48
RESULTS = ("host", "path", "rule", "verdict")


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


class Level:
    """One Bloom filter: all bits of a key lie in one word of 64, so a test is one look-up and one mask. The words are in
    chunks in a table of one row."""

    def __init__(self, number: int, keys: DataFrame, n: int, rate: float):
        self.number = number
        self.ones = min(10, max(1, round(-math.log2(rate))))
        self.words = max(1, math.ceil(ROOM * n * -math.log(rate) / math.log(2) ** 2 / 64))
        self.chunks = math.ceil(self.words / CHUNK_WORDS)
        spark = keys.sparkSession
        made = keys.select(self._word(F.col("h1"), F.col("h2")).alias("word"), self._bits(F.col("h1"), F.col("h2")).alias("bits"))
        made = made.unionByName(spark.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        in_order = lambda by: F.transform(F.sort_array(F.collect_list(F.struct(by, "bits"))), lambda x: x["bits"])
        chunks = made.groupBy(F.floor(F.col("word") / CHUNK_WORDS).alias("chunk")).agg(in_order("word").alias("bits"))
        self.table = written(chunks.agg(in_order("chunk").alias("words")), f"filter-{number}")

    def _word(self, h1: Column, h2: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.number), h1, h2), F.lit(self.words).cast("long"))

    def _bits(self, h1: Column, h2: Column) -> Column:
        mixed, one = F.xxhash64(F.lit(-self.number), h1, h2), F.lit(1).cast("long")
        bits = F.lit(0).cast("long")
        for k in range(self.ones):
            bits = bits.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(mixed, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
        return bits

    def has(self, words: Column, first: int, h1: Column, h2: Column) -> Column:
        """Whether the level takes a key for one of its own, by the two hashes of the key; its chunks begin at `first`."""
        word, bits = self._word(h1, h2), self._bits(h1, h2)
        chunk = F.get(words, F.shiftrightunsigned(word, CHUNK_WORDS.bit_length() - 1).cast("int") + first)
        return F.get(chunk, word.bitwiseAND(F.lit(CHUNK_WORDS - 1)).cast("int")).bitwiseAND(bits) == bits


class Cascade:
    """Exact membership in `listed` (key) for all keys of `universe` (key); keys outside of both may be taken for listed.

    Both are distinct and without nulls. The first level errs as often as leaves about as many wrong keys as there are
    listed ones, later ones err half the time, so the levels halve. Rounds beyond the first read only what the
    round before took wrongly. All words are one value of one row, which a scalar subquery hands to every task.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        h1, h2 = hashes(F.col("key"))
        marked = universe.join(listed.select("key", F.lit(True).alias("listed")).hint("shuffle_merge"), "key", "left")
        marked = written(marked.select("key", F.col("listed").isNotNull().alias("listed"), h1.alias("h1"), h2.alias("h2")), "marked-keys")
        ins, outs = marked.where("listed"), marked.where("not listed")
        n_in, n_out = ins.count(), outs.count()
        self.levels: list[Level] = []
        rate = min(0.5, math.sqrt(0.5) * n_in / n_out) if n_in and n_out else 0.5
        rounds = [marked]
        while n_in:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError(f"{n_in} keys agree in all hashes with others")
            level = Level(len(self.levels) + 1, ins, n_in, rate)
            self.levels.append(level)
            rounds.append(written(outs.where(level.has(level.table.scalar(), 0, F.col("h1"), F.col("h2"))), "taken-keys"))
            outs, ins = ins, rounds[-1]
            n_in, rate = ins.count(), 0.5
        for done in rounds:
            dropped(done)
        if self.levels:
            one = self.levels[0].table
            for level in self.levels[1:]:
                # tables of one row
                one = one.crossJoin(F.broadcast(level.table.withColumnRenamed("words", "more"))).select(F.concat("words", "more").alias("words"))
            self.table = written(one, "cascade")
            for level in self.levels:
                dropped(level.table)

    @property
    def bytes(self) -> int:
        return 8 * sum(x.words for x in self.levels)

    def has(self, key: Column) -> Column:
        """Whether a key is listed; null for a null key."""
        h1, h2 = hashes(key)
        found = F.lit(len(self.levels) % 2 == 1)
        first = sum(x.chunks for x in self.levels)
        for level in reversed(self.levels):
            first -= level.chunks
            # what this level denies belongs to the side that it doesn't encode
            found = F.when(level.has(self.table.scalar(), first, h1, h2), found).otherwise(F.lit(level.number % 2 == 0))
        return F.when(key.isNotNull(), found)


def expected_bytes(listed: int, universe: int) -> float:
    """Bytes of a cascade: the first level by its rate of errors, and about one byte a listed key for all that follow."""
    rate = min(0.5, math.sqrt(0.5) * listed / max(universe - listed, 1)) if listed else 0.5
    return listed * (ROOM * -math.log(rate) / math.log(2) ** 2 / 8 + 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to /, ?, # or the end, A to Z lower-cased. Path: from there up to ?, # or the end."""
    pattern = "://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(x, F.lit("")) for x in (lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)))


def _suffix(host: Column, labels: int) -> Column:
    """The last labels of a host, null if it has fewer."""
    return F.when((host != "") & (F.regexp_count(host, F.lit(r"\.")) >= labels - 1), F.substring_index(host, ".", -labels))


def _rule_shapes(rules: Iterable[tuple[str, str, str]]) -> list[tuple[int, int, str]]:
    """(labels, characters of the path, verdict) of the rules, each once; the longest host and path first."""
    return sorted({(host.count(".") + 1, len(path), verdict) for host, path, verdict in rules}, reverse=True)


def _rule_key(host: Column, path: Column, labels: int, chars: int, verdict: str) -> Column:
    start = F.when(F.length(path) >= chars, F.substring(path, 1, chars))
    return F.concat(F.lit(f"{verdict} "), _suffix(host, labels), start)


def listed_hosts(hosts: DataFrame, terms: Iterable[str] = TERMS) -> DataFrame:
    """The hosts (host) that have a listed term as a word of a label."""
    return hosts.where(F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*[F.lit(t) for t in terms]))).select("host")


def url_filter(pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of pages (url, ...) with host, path, rule and verdict (allow or block).

    The longest rule that fits decides (of equally long ones that with the longer host, then block); its text is `rule`.
    Without a rule a url is blocked if `listed` (host) has its host or a domain above it. A null url and one
    without :// have an empty host, fit no rule and are allowed. Null, empty and repeated listed hosts count
    for nothing or once. Two rules of one host and path with different verdicts: block. Kept columns named as a result are
    replaced; repeated rows are judged alike; no rows give no rows.

    rules is a list in the program, and its shapes (labels, path length, verdict) are columns of the plan. A url costs
    one test of the cascade for each shape and each number of labels among the listed hosts. Urls are read twice, for
    the universe and for the verdicts, and never shuffled; distinct keys are, after partial distinct, so a host with a
    third of all urls sends one row from each task. Filters of more than FILTER_BYTES are cut by a hash of the keys and
    looked up in as many passes; a pass broadcasts no more than that.
    """
    spark, rules = pages.sparkSession, list(rules)
    names = [c for c in (pages.columns if keep is None else keep) if c not in RESULTS and not c.startswith("uf_")]
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*names, host.alias("uf_host"), path.alias("uf_path"))
    host, path = F.col("uf_host"), F.col("uf_path")
    listed = listed.select(F.col("host").alias("uf_key")).where("uf_key <> ''").distinct()
    depth = [r.n for r in listed.select((F.regexp_count("uf_key", F.lit(r"\.")) + 1).alias("n")).distinct().orderBy("n").collect()]
    shapes = _rule_shapes(rules)
    keys = [_rule_key(host, path, *shape) for shape in shapes] + [F.concat(F.lit("list "), _suffix(host, n)) for n in depth]
    if not keys:
        return rows.select(*names, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    universe = written(pages.select(*[x.alias(c) for x, c in zip(host_and_path(F.col("url")), ("uf_host", "uf_path"), strict=True)]).select(F.explode(F.array(*keys)).alias("key")).where("key is not null").distinct(), "url-keys")
    ruled = spark.createDataFrame([(f"{v} {h}{p}",) for h, p, v in rules], "key string").distinct()
    wanted = written(ruled.unionByName(listed.select(F.concat(F.lit("list "), "uf_key").alias("key"))), "listed-keys")
    parts = max(1, math.ceil(1.5 * expected_bytes(wanted.count(), universe.count()) / FILTER_BYTES))
    part_of = lambda key: F.pmod(F.xxhash64(key), F.lit(parts))
    hits: list[Column] = [F.lit(None).cast("boolean")] * len(keys)
    for part in range(parts):
        cascade = Cascade(wanted.where(part_of(F.col("key")) == part), universe.where(part_of(F.col("key")) == part))
        if cascade.bytes > 2 * FILTER_BYTES:
            raise RuntimeError(f"{cascade.bytes} bytes of filters in one pass, far more than keys alone explain")
        own = [F.when(part_of(key) == part, cascade.has(key)) if parts > 1 else cascade.has(key) for key in keys]
        rows = rows.withColumns({f"uf_hit{k}": F.coalesce(hit, before) for k, (hit, before) in enumerate(zip(own, hits, strict=True))})
        rows = written(rows, "url-hits") if part < parts - 1 else rows
        hits = [F.col(f"uf_hit{k}") for k in range(len(keys))]
    dropped(universe)
    dropped(wanted)
    fits = []
    for hit, (n, chars, verdict) in zip(hits, [*shapes, *[(n, -1, "block") for n in depth]], strict=True):
        size, rule = F.length(_suffix(host, n)), F.concat(_suffix(host, n), F.substring(path, 1, max(chars, 0)))
        # a listed host counts less than any rule
        fits.append(F.when(hit, F.struct((size + chars if chars >= 0 else F.lit(-1)).alias("size"), size.alias("own"), F.lit(verdict).alias("verdict"), (rule if chars >= 0 else F.lit(None).cast("string")).alias("rule"))))
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    rows = rows.select(*names, host.alias("host"), path.alias("path"), best.alias("uf_best"))
    return rows.select(*names, "host", "path", F.col("uf_best.rule").alias("rule"), F.coalesce("uf_best.verdict", F.lit("allow")).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct()
    return url_filter(pages, listed_hosts(hosts), keep=["page_id"])


OP12_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS r FROM pages),
rules(rh, rp, rv) AS (VALUES {", ".join(str(x) for x in RULES)}),
fit AS (SELECT r, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r),
listed AS (SELECT DISTINCT host AS lh FROM p WHERE list_has_any(regexp_split_to_array(host, '[.\-]'), [{", ".join(f"'{t}'" for t in TERMS)}])),
named AS (SELECT DISTINCT host AS nh FROM (SELECT DISTINCT host FROM p) JOIN listed ON host = lh OR ends_with(host, '.' || lh))
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN nh IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit USING (r) LEFT JOIN named ON host = nh
"""
