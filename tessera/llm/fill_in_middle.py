"""Fill-in-the-middle transformation by big-integer bit-parallelism.

A text's UTF-8 bytes become one big integer with a bit for each byte, the first byte highest: bytes.translate builds the
mask of a byte class, and shifted boolean operations on such masks mark the last byte of every unit. bit_count gives
the number of units, and the byte at which the k-th unit ends is found by halving the integer and counting the ones of
its upper half. So a text is never split into units, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of a hundred texts, how many are rearranged, and of those, how many with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
RESULTS = ("n_units", "form", "prefix_units", "middle_units", "fim_text")


def _class(members: bytes | range) -> bytes:
    """A table for bytes.translate: 1 for bytes of the class, 0 for others."""
    inside = set(members)
    return bytes(0x31 if b in inside else 0x30 for b in range(256))


_LEAD = _class([*range(0x80), *range(0xC0, 0x100)])
_WORD = _class([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
_NEWLINE = _class(b"\n")


def _mask(data: bytes, of: bytes) -> int:
    return int(data.translate(of), 2)


def _char_ends(data: bytes) -> int:
    """A code point ends before a byte that leads the next one, and at the last byte."""
    return (_mask(data, _LEAD) << 1) & ((1 << len(data)) - 1) | 1


def _word_ends(data: bytes) -> int:
    """A word goes with the white space behind it, and white space before the first word with that word."""
    word = _mask(data, _WORD)
    first = word & ~(word >> 1)
    ends = (first << 1) & ((1 << len(data)) - 1) | 1
    lead = len(data) - word.bit_length()
    return ends & ~(1 << word.bit_length()) if word and lead else ends


def _line_ends(data: bytes) -> int:
    """A line ends with its newline, or with the text."""
    return _mask(data, _NEWLINE) | 1


ENDS: dict[str, Callable[[bytes], int]] = {"char": _char_ends, "word": _word_ends, "line": _line_ends}


def select(bits: int, width: int, k: int) -> int:
    """The place, counted from the highest of width bits, of the k-th one (from 1), by halving."""
    at = 0
    while width > 1:
        low = width >> 1
        high = bits >> low
        ones = high.bit_count()
        if k <= ones:
            bits, width = high, width - low
        else:
            bits, k, at, width = bits & ((1 << low) - 1), k - ones, at + width - low, low
    return at


def cut(data: bytes, unit: str, draws: Callable[[int], tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """(units, units of the prefix, units of the middle, first byte of the middle, first byte of the suffix)."""
    if not data:
        return 0, 0, 0, 0, 0
    ends = ENDS[unit](data)
    n = ends.bit_count()
    a, b = sorted(draws(n))
    i, j = (select(ends, len(data), k) + 1 if k else 0 for k in (a, b))
    return n, a, b - a, i, j


def _transformed(keep: int, unit: str, marks: tuple[str, str, str], fim: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in marks)
        for batch in batches:
            rows: list[tuple] = []
            for text, h1, h2, h3, h4 in zip(*(batch.column(keep + k) for k in range(5)), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, a, mid, i, j = cut(data, unit, lambda n, x=h1.as_py(), y=h2.as_py(): (x % (n + 1), y % (n + 1)))
                if not data or p in data or s in data or m in data or h3.as_py() % 100 >= fim:
                    rows.append((n, "plain", None, None, data))
                elif h4.as_py() % 100 < spm:
                    rows.append((n, "spm", a, mid, b"".join((s, data[j:], p, data[:i], m, data[i:j]))))
                else:
                    rows.append((n, "psm", a, mid, b"".join((p, data[:i], s, data[j:], m, data[i:j]))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *made], names=[*batch.schema.names[:keep], *RESULTS])

    return run


def draw(k: int, seed: str = SEED) -> Column:
    """The k-th group of eight digits (from 0) of the sha256 of the seed and doc_id, as an unsigned number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, unit: str = "char", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The kept columns of docs (doc_id, text, ...; all but text by default) with n_units, form, prefix_units,
    middle_units and fim_text.

    unit is char (code points), word or line. Both cuts are drawn from doc_id, so reruns agree and rows with one doc_id
    draw alike; rows without doc_id draw by the seed alone. A null text counts as empty; an empty text, one that holds
    a mark and one that isn't drawn are plain: fim_text is the text, the unit counts are null. Kept columns named as a
    result are dropped. No rows give no rows. Rows stay where they are: no shuffle, and a task holds one Arrow batch.
    """
    prepare(docs.sparkSession)
    own = [f"fim_draw_{k}" for k in range(4)]
    names = [c for c in ([c for c in docs.columns if c != "text"] if keep is None else keep) if c not in RESULTS and c not in ("fim_bytes", *own)]
    fields = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in names)
    rows = docs.select(*names, F.col("text").cast("binary").alias("fim_bytes"), *[draw(k, seed).alias(c) for k, c in enumerate(own)])
    made = rows.mapInArrow(_transformed(len(names), unit, marks, fim_percent, spm_percent), fields + "n_units long, form string, prefix_units long, middle_units long, fim_text binary")
    return made.withColumn("fim_text", F.col("fim_text").cast("string"))


def restored(text: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that fill_in_middle had, from its output and form. No mark stands in the text, so each stands once here."""
    p, s, m = (F.lit(x) for x in marks)
    part = lambda x, mark, k: F.split_part(x, mark, F.lit(k))
    skip = lambda x, mark: F.substring(x, F.length(mark) + 1, 2**31 - 1)
    middle = part(text, m, 2)
    psm = F.concat(skip(part(text, s, 1), p), middle, part(part(text, s, 2), m, 1))
    spm = F.concat(part(part(text, p, 2), m, 1), middle, skip(part(text, p, 1), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("fim_text")).alias("output_sha256"), digest(restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, least(x, y)) AS pre, substr(text, least(x, y) + 1, abs(x - y)) AS mid, substr(text, greatest(x, y) + 1) AS suf FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
