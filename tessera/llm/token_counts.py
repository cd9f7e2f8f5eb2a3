"""Token counts by batch encoding in Arrow functions that return lengths only.

Where a text may be cut is read from the tokenizer itself, never from its name (see cutting). Texts are cut there, the
parts are encoded in batches of about equal bytes, and the numbers of tokens are summed up by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .textkit import PIECE, Spans, U, pieces, words

#: Bytes of text that go to the tokenizer at once, and the length from which split_safely splits a text.
BATCH_BYTES = 1 << 18
SPLIT_BYTES = 1 << 16
#: Pieces whose token numbers a worker keeps, as a power of two.
CACHE_BITS = 20
LIMIT = 2048
_WHITE = " \t\n\v\f\r"
_SAFE = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _counter(path: str):
    """Texts to token numbers, as the file's library gives them without begin, end or added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return lambda texts: [len(e) for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]


def _steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a normaliser or pre-tokenizer, which may be none, one or a sequence."""
    if part is None:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def _json_cutting(made: dict) -> str | None:
    normal, split = _steps(made.get("normalizer"), "normalizers"), _steps(made.get("pre_tokenizer"), "pretokenizers")
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in made.get("added_tokens", [])) or not split:
        return None
    # steps that change no character together with a white space
    local = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in normal)
    first = split[0]
    if local and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and (pattern := first["pattern"].get("Regex")):
        probe = "".join(x + w + y for w in _WHITE for x in "a1'.é" for y in "s1'.é") + _WHITE
        if not any(re.search(r"\s", m[0]) for m in regex.finditer(pattern, probe)):
            return "white"
    if not normal and len(split) == 1 and first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return "before"
    return None


@lru_cache(maxsize=4)
def cutting(path: str) -> str | None:
    """Where a text may be cut without changing its number of tokens.

    `white`: at any white space, as it makes no token: the pre-tokenizer keeps only what a pattern matches, and that holds
    none. `before`: before a space between two letters or digits of ASCII, as the byte-level pattern begins a token there.
    `drop`: in its place, as a model without any piece that goes on after a word mark gives each part the mark that
    stands for the space. None: nowhere; such texts are encoded whole.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return _json_cutting(json.load(f))
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    mark = "\u2581"
    apart = not any(mark in model.id_to_piece(k).lstrip(mark) for k in range(model.get_piece_size()))
    probe = ["ab cd", "x 1", "7 seven"]
    return "drop" if apart and all(model.encode(t) == [i for p in t.split(" ") for i in model.encode(p)] for t in probe) else None


def split_safely(text: bytes, how: str | None, limit: int = SPLIT_BYTES) -> list[bytes]:
    """Parts of a text of about `limit` bytes or more whose token numbers add up to those of the text (see cutting).

    Where no place to cut follows, the rest stays whole.
    """
    parts, at = [], 0
    while how and len(text) - at > limit and (found := (_GAP if how == "white" else _SAFE).search(text, at + limit)):
        parts.append(text[at : found.start()])
        at = found.start() if how == "before" else found.end()
    return [*parts, text[at:]]


def _counts(path: str, n_keep: int):
    """n_bytes and n_tokens of the column after the kept ones.

    Where white space makes no token, texts are cut at all of it, and the distinct pieces of a batch that the worker
    hasn't met lately are encoded: a table of CACHE_BITS keeps the token numbers of pieces by their 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, how = _counter(path), cutting(path)
        keys, known = np.zeros(1 << CACHE_BITS, U), np.zeros(1 << CACHE_BITS, np.int64)

        def encoded(texts: Iterator[bytes]) -> np.ndarray:
            """Token numbers of texts, encoded in batches of about BATCH_BYTES."""
            out: list[int] = []
            held: list[str] = []
            size = 0
            for raw in texts:
                held.append(raw.decode("utf-8", "replace"))
                size += len(raw)
                if size >= BATCH_BYTES:
                    out += count(held)
                    held, size = [], 0
            return np.array(out + (count(held) if held else []), np.int64)

        def of_pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            h = Spans(buf)(start, end)
            slot = (h >> U(64 - CACHE_BITS)).astype(np.int64)
            out = known[slot]
            missed = np.flatnonzero((keys[slot] != h) | (h == 0))
            if len(missed):
                new, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
                at = missed[first]
                got = encoded(bytes(buf[start[k] : end[k]]) for k in at)
                out[missed] = got[back]
                keys[slot[at]], known[slot[at]] = new, got
            return out

        for batch in batches:
            column = batch.column(n_keep)
            sizes, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, buf, offsets in pieces(column):
                sizes[a:b] = np.diff(offsets)
                # only a row of its own is longer than PIECE
                parts = [(buf, offsets, np.arange(a, b))]
                if how != "white":
                    cut = [(r, p) for r, x, y in zip(range(a, b), offsets[:-1], offsets[1:], strict=True) for p in split_safely(bytes(buf[x:y]), how)]
                    np.add.at(tokens, [r for r, _ in cut], encoded(p for _, p in cut))
                    continue
                if len(buf) > PIECE:
                    parts = [(np.frombuffer(p, np.uint8), np.array([0, len(p)]), np.array([a])) for p in split_safely(buf.tobytes(), how, PIECE)]
                for own, places, rows in parts:
                    start, end, first = words(own, places)
                    sums = np.concatenate([[0], np.cumsum(of_pieces(own, start, end))])
                    tokens[rows] += sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(sizes), pa.array(tokens)], names=[*batch.schema.names[:n_keep], "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs (text, ...) with n_bytes, n_tokens and over_limit of the whole text.

    A null or empty text has 0 bytes and 0 tokens. Kept columns named as a result are dropped. Rows stay where they
    are: there is no shuffle, a lost task is run again by itself, and a task holds one batch of BATCH_BYTES at a time.
    """
    prepare(docs.sparkSession)
    kept = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in kept)
    counted = docs.select(*kept, "text").mapInArrow(_counts(path, len(kept)), ", ".join(x for x in (fields, "n_bytes long, n_tokens long") if x))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), path or default_path("word_bpe_49k.json"))
