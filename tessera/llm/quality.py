"""Quality rules with host-level verdicts.

Document rules are counted in one pass over the texts. Failures are then summed by host (here: source) and each host's
failure rate is shrunk towards the other hosts by a beta prior fitted to their rates. A host is rejected with all its
documents if its shrunk rate lies beyond what that prior holds likely: DEVIATIONS standard deviations above its mean,
and at least RATIO times the mean; above MAX_HOST_RATE it is rejected in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, small, table, written
from .textkit import Spans, U, mix, pieces, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document also counts as a failure of its host with more symbols for a hundred words, or more repeated lines, than this.
MAX_SYMBOL_PERCENT = 50
MAX_DUP_LINES = 50
#: Hosts are rejected beyond this many standard deviations of the prior above its mean and this multiple of the mean.
DEVIATIONS, RATIO = 3.0, 1.5
#: Hosts are rejected above this shrunk rate of failed documents, whatever the others do.
MAX_HOST_RATE = 0.6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_NEVER = np.zeros(256, bool)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(column: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text."""
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for a, b, buf, offsets in pieces(column):
        hashed = Spans(buf)
        start, end, first = words(buf, offsets)
        line_start, line_end, line_first = words(buf, offsets, _NEWLINE)
        heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
        chars = np.concatenate([[0], np.cumsum(heads[end] - heads[start])])
        h = hashed(start, end)
        grams = mix(mix(mix(h[:-2]) * U(0x9E3779B97F4A7C15) + h[1:-1]) * U(0x9E3779B97F4A7C15) + h[2:]) if len(h) > 2 else h[:0]
        has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        lines = hashed(line_start, line_end)
        for i in range(b - a):
            f, g = first[i], first[i + 1]
            row = out[a + i]
            row[0] = n = g - f
            row[1] = chars[g] - chars[f]
            row[2] = symbols[offsets[i + 1]] - symbols[offsets[i]]
            own = lines[line_first[i] : line_first[i + 1]][has_word[line_first[i] : line_first[i + 1]]]
            row[3] = len(own) - len(np.unique(own))
            if n > 2:
                _, where, times = np.unique(grams[f : g - 2], return_inverse=True, return_counts=True)
                twice = times[where] > 1
                covered = np.zeros(n, bool)
                for k in range(3):
                    covered[k : n - 2 + k] |= twice
                row[4] = covered.sum()
    return out


def _counted(n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column(n_keep))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *[pa.array(found[:, k]) for k in range(len(COUNTS))]], names=[*batch.schema.names[:n_keep], *COUNTS])

    return run


def rule_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of docs (text, ...) with COUNTS, base_failed and failed (any rule, for the host's rate)."""
    prepare(docs.sparkSession)
    fields = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    out = docs.select(*keep, "text").mapInArrow(_counted(len(keep)), fields + ", ".join(f"{c} long" for c in COUNTS))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINES)
    return out.withColumn("base_failed", base).withColumn("failed", base | more)


def host_rates(hosts: DataFrame, max_rate: float = MAX_HOST_RATE, deviations: float = DEVIATIONS, ratio: float = RATIO) -> DataFrame:
    """hosts (host, n, k) with rate = (k + alpha) / (n + alpha + beta) and limit, by a beta prior fitted to the other hosts.

    The prior's mean m is that of all documents of other hosts; its weight alpha + beta comes from the variance of their
    rates around m, weighted by documents, less what sampling alone would give: m (1 - m) / variance - 1. It is at most
    the mean number of documents of the other hosts, as they show no more of how hosts differ. Its variance is m (1 - m) / (weight + 1), and the limit is
    max(ratio * m, m + deviations * sqrt(variance)), at most max_rate. A host without others keeps its own rate and has
    the limit max_rate.
    """
    sums = hosts.agg(F.sum("k").alias("sk"), F.sum("n").alias("sn"), F.count("*").alias("hosts"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("skk"))
    # one row
    own = hosts.crossJoin(F.broadcast(sums)).withColumn("on", F.col("sn") - F.col("n")).withColumn("m", F.coalesce(F.try_divide(F.col("sk") - F.col("k"), F.col("on")), F.lit(0.0)))
    own = own.withColumn("between", F.try_divide(F.col("skk") - F.col("k") * F.col("k") / F.col("n"), F.col("on")) - F.col("m") * F.col("m")).withColumn("noise", F.col("m") * (1 - F.col("m")))
    own = own.withColumn("each", F.coalesce(F.try_divide("on", F.col("hosts") - 1), F.lit(0.0)))
    own = own.withColumn("excess", F.col("between") - F.try_divide((F.col("hosts") - 1) * F.col("noise"), F.col("on")))
    own = own.withColumn("weight", F.when(F.col("excess") > 1e-12, F.least(F.greatest(F.col("noise") / F.col("excess") - 1, F.lit(0.0)), F.col("each"))).otherwise(F.col("each")))
    limit = F.greatest(ratio * F.col("m"), F.col("m") + deviations * F.sqrt(F.col("noise") / (F.col("weight") + 1)))
    limit = F.when(F.col("on") > 0, F.least(limit, F.lit(max_rate))).otherwise(F.lit(max_rate))
    return own.select(*hosts.columns, ((F.col("k") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"), limit.alias("limit"))


def verdicts(docs: DataFrame, keep: list[str] | None = None, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The kept columns of docs with COUNTS, base_failed, host_rate, host_limit and kept.

    Null and empty texts have no words, so they fail. A null host is a host of its own. Kept columns named as a result,
    failed or qr_host are dropped. Rows that repeat others count again. No rows give no rows. The counts are written once
    with the kept columns, and read by hosts and for the rows, which stay whole: a host of any share of the rows is
    summed in part before the shuffle and joined as one row.
    """
    results = (*COUNTS, "base_failed", "failed", "host_rate", "host_limit", "kept", "qr_host")
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = written(rule_counts(docs.withColumn("qr_host", F.col(host)), [*names, "qr_host"]), "rule-counts")
    hosts = rows.groupBy("qr_host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    rates = written(host_rates(hosts, max_rate).select(F.col("qr_host").alias("h_host"), F.col("rate").alias("host_rate"), F.col("limit").alias("host_limit")), "host-rates")
    out = rows.join(small(rates, rates.count()), F.col("qr_host").eqNullSafe(F.col("h_host")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= F.col("host_limit"))).select(*names, *COUNTS, "base_failed", "host_rate", "host_limit", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return verdicts(docs, keep=["doc_id"]).drop("host_rate", "host_limit")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM t) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 50 * n_words OR n_dup_lines > 50 AS failed FROM c),
hs AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM f GROUP BY source),
hall AS (SELECT sum(k) AS sk, sum(n) AS sn, count(*) AS hosts, sum(k * k / n) AS skk FROM hs),
o AS (SELECT source, n, k, hosts, sn - n AS rest, skk - k * k / n AS others, CASE WHEN sn > n THEN (sk - k) / (sn - n) ELSE 0 END AS m FROM hs, hall),
e AS (SELECT *, CASE WHEN rest > 0 THEN others / rest - m * m - (hosts - 1) * m * (1 - m) / rest END AS excess FROM o),
pw AS (SELECT *, CASE WHEN excess > 1e-12 THEN least(greatest(m * (1 - m) / excess - 1, 0), rest / (hosts - 1)) WHEN rest > 0 THEN rest / (hosts - 1) ELSE 0 END AS wt FROM e),
hr AS (SELECT source, (k + m * wt) / (n + wt) AS rate, CASE WHEN rest > 0 THEN least(greatest(1.5 * m, m + 3 * sqrt(m * (1 - m) / (wt + 1))), 0.6) ELSE 0.6 END AS most FROM pw)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= most AS kept
FROM f JOIN hr ON f.source IS NOT DISTINCT FROM hr.source
"""
