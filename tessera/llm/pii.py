"""Personal data in texts: exact base patterns, and a character-level BiLSTM-CRF that adds spans.

The tagger is trained on labelled spans planted into texts of the corpus itself. It knows the base kinds in writings that
the patterns miss, and secrets (keys, tokens, passwords), of which there is no pattern. It reads the whole of every text
that holds a digit or an @, in overlapping windows; a span that it adds must hold one of these, so nothing is lost in
the other texts. Each character takes its tag from the window in which it
stands furthest from an edge, and spans are built from these tags over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .pii_model import KINDS, Tagger, encode, trained

WINDOW, OVERLAP = 96, 32
#: Texts of the corpus, and characters of each, among which the labelled spans are planted.
CONTEXTS, CONTEXT_CHARS = 400, 300
BASE = KINDS[:4]
WINDOWS_AT_ONCE = 256
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]+")
_CODE = re.compile(r"[A-Za-z0-9_+/-]++")
_AROUND = " .,;:=\n\"'"
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and without overlap, from every @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind as in KINDS and then by start."""
    out = [(0, a, b) for a, b in emails(text)]
    if text.count(".") > 2:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Windows of at most WINDOW characters that overlap by OVERLAP and cover [start, end)."""
    out = []
    while True:
        stop = min(start + WINDOW, end)
        out.append((start, stop))
        if stop == end:
            return out
        start = stop - OVERLAP


def plausible(kind: int, value: str) -> bool:
    """Whether an added span can be what it is tagged as."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == 0:
        local, at, domain = value.partition("@")
        return bool(at) and bool(local.strip()) and "." in domain.strip(" .") and "\n" not in value
    if kind == 1:
        parts = [x.strip() for x in value.split(".")]
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 4:
        return len(value) >= 10 and bool(digits) and len(digits) < len(value) and not re.search(r"\s", value)
    return 9 <= len(digits) <= 15 and "\n" not in value and not re.search(r"[A-Za-z]", value)


class Tags:
    """Windows of many texts, decoded a batch at a time."""

    def __init__(self, model: Tagger):
        self.model, self.jobs, self.result = model, [], {}

    def add(self, row: int, text: str) -> None:
        cover = windows(0, len(text))
        for k, (s, e) in enumerate(cover):
            low = s if k == 0 else s + OVERLAP // 2
            high = e if k == len(cover) - 1 else e - (OVERLAP - OVERLAP // 2)
            self.jobs.append((row, s, low, high, encode(text[s:e])))
            if len(self.jobs) >= WINDOWS_AT_ONCE:
                self.flush()

    def flush(self) -> None:
        for at in range(0, len(self.jobs), WINDOWS_AT_ONCE):
            jobs = self.jobs[at : at + WINDOWS_AT_ONCE]
            lengths = np.array([len(j[4]) for j in jobs])
            x = np.zeros((len(jobs), lengths.max()), np.int64)
            for r, j in enumerate(jobs):
                x[r, : len(j[4])] = j[4]
            tags = self.model.decode(x, lengths)
            for r, (row, s, low, high, _) in enumerate(jobs):
                own = tags[r, low - s : high - s]
                self.result.setdefault(row, []).extend((low + int(k), int(own[k])) for k in np.flatnonzero(own))
        self.jobs = []

    def spans(self, row: int) -> list[tuple[int, int, int]]:
        """(kind, start, end) of runs of one kind over the text."""
        out: list[list[int]] = []
        for at, tag in sorted(self.result.pop(row, [])):
            kind = (tag - 1) // 2
            if out and out[-1][2] == at and out[-1][0] == kind and tag % 2 == 0:
                out[-1][2] = at + 1
            else:
                out.append([kind, at, at + 1])
        return [(k, a, b) for k, a, b in out]


def _whole_secrets(text: str, added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the other kinds, and each run of code characters of which at least half is tagged as secret."""
    out = [x for x in added if x[0] != 4]
    secret = [(a, b) for k, a, b in added if k == 4]
    if not secret:
        return out
    # the runs of the text, once; tagged spans are in order
    runs = [(m.start(), m.end()) for m in _CODE.finditer(text, 0)]
    starts, tagged = [a for a, _ in runs], [0] * len(runs)
    for a, b in secret:
        k = max(bisect_right(starts, a) - 1, 0)
        while k < len(runs) and runs[k][0] < b:
            tagged[k] += max(0, min(b, runs[k][1]) - max(a, runs[k][0]))
            k += 1
    return out + [(4, a, b) for (a, b), n in zip(runs, tagged, strict=True) if n and 2 * n >= b - a]


def merged(text: str, base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those added ones that are plausible, whole words and clear of base spans, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = list(base)
    for kind, a, b in _whole_secrets(text, added):
        while b > a and text[b - 1] in _AROUND:
            b -= 1
        while a < b and text[a] in _AROUND:
            a += 1
        inside = text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()
        # spans that begin before b, of which the farthest end tells whether one goes beyond a
        before = bisect_left(starts, b)
        if b > a and not inside and not (before and reach[before - 1] > a) and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return sorted(out)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


RESULTS = (*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "private")


def _found(weights: dict, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = weights
        for batch in batches:
            tags = Tags(model)
            texts = batch.column(n_keep)
            n = batch.num_rows
            base: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            for i in range(n):
                text = texts[i].as_py()
                if text and _SIGN.search(text):
                    base[i] = base_spans(text)
                    tags.add(i, text)
            tags.flush()
            every = []
            for i in range(n):
                added = tags.spans(i)
                every.append(merged(texts[i].as_py(), base[i], added) if added else base[i])
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(len(BASE))]
            sha = pa.array([hashlib.sha256(_named(b).encode()).hexdigest() for b in base])
            more = [pa.array([_named(e) for e in every], pa.string()), pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64()), pa.array([bool(e) for e in every], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *counts, sha, *more], names=[*batch.schema.names[:n_keep], *RESULTS])

    return run


def contexts(docs: DataFrame, texts: int = CONTEXTS, chars: int = CONTEXT_CHARS) -> tuple[str, ...]:
    """At most `texts` cuts of `chars` characters, from anywhere in texts of docs that hold no digit and no @.

    Those with the least hash of the text are taken, so that the same documents give the same cuts.
    """
    plain = docs.select("text").where(F.length("text") >= 20).where(~F.col("text").rlike("[0-9@]"))
    key = F.md5(F.col("text").cast("binary"))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    picked = plain.select(key.alias("key"), F.substring(F.col("text"), at, F.lit(chars)).alias("cut")).orderBy("key", "cut").limit(texts).collect()
    return tuple(r["cut"] for r in picked)


def personal_data(docs: DataFrame, model: Tagger | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs (text, ...) with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and private.

    Counts and hash are of the base spans; spans holds base and added ones as kind:start:end in code points, n_added
    counts the added ones, and private tells whether there is any span. Null and empty texts have none. Kept columns named
    as a result are dropped. No rows give no rows. There is no shuffle but that of the CONTEXTS cuts, and the model is a
    few thousand numbers, trained once on the driver from labelled spans planted into these cuts, the same in every run.
    """
    prepare(docs.sparkSession)
    names = [c for c in keep if c not in RESULTS]
    fields = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in names)
    model = model or trained(contexts=contexts(docs))
    types = ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_added long, private boolean"
    return docs.select(*names, "text").mapInArrow(_found(model.p, len(names)), fields + types)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
