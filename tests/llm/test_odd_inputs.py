"""Texts above the size of a piece, empty tables, and columns named as an operator's own."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import pii, pii_model, toxicity
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.quality import counts
from tessera.llm.textkit import PIECE


@pytest.fixture(scope="module")
def long():
    """Words of a text of more than a piece, few of which repeat."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghiéß", k=r.randint(3, 12))) for _ in range(PIECE // 7)]
    assert len(" ".join(words).encode()) > PIECE
    return words


def test_pipeline_of_nothing(spark, made, tmp_path):
    made([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES:
        out = stage(spark, made([]), str(tmp_path))
        assert out.count() == 0 and set(P.COLUMNS) <= set(out.columns)
    assert P.run(spark, str(tmp_path)).collect() == []


def test_stages_with_clashing_columns_and_long_texts(spark, made, tmp_path, long):
    text = " ".join(long)
    near = " ".join([*long[:-1], "other"])
    test = " ".join(f"b{k}" for k in range(30))
    good = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(20)]
    rows = [(1, text, "s"), (2, near, "s"), (3, " ".join(long[::-1]) + " " + test, None), (4, None, "s"), (5, "", None), (None, good[0], "s"), (None, None, None)] + [(10 + i, good[i], "st"[i % 2]) for i in range(20)]
    made([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["kept", "component_id", "n_shingles", "tk", "k_id", "h_id", "node", "qr_host", "failed", "mix_times", "mix_copy", "mix_size", "shard", "slot", "items", "h_tk"]
    want = {"quality_rules": {"1", "2", "3", "None", *map(str, range(10, 30))}}
    want["near_dedup"] = want["quality_rules"] - {"2"}
    want["decontaminate"] = want["near_dedup"] - {"3"}
    plain = made(rows)
    for name, stage in P.STAGES:
        odd = plain.withColumns({c: F.lit("x") for c in extra})
        a, b = (stage(spark, d, str(tmp_path)) for d in (plain, odd))
        assert a.columns == b.columns
        key = lambda d: sorted((str(r.doc_id), hashlib.md5((r.text or "").encode()).hexdigest(), str(r.source)) for r in d.select(*P.COLUMNS).collect())
        assert key(a) == key(b)
        if name in want:
            assert {i for i, _, _ in key(a)} == want[name]
            a.select(*P.COLUMNS).write.parquet(f"{tmp_path}/{name}")
            plain = spark.read.parquet(f"{tmp_path}/{name}")


def test_long_texts_are_compared_whole(made, long):
    """Copies that differ only beyond the first piece, by more and by less than the threshold."""
    n = len(long)
    fresh = [f"new{k}" for k in range(n)]
    rows = [(1, " ".join(long), "s"), (2, " ".join(long[: n * 19 // 20] + fresh[n * 19 // 20 :]), "s"), (3, " ".join(long[: n * 3 // 4] + fresh[n * 3 // 4 :]), "s")]
    out = {r.doc_id: r for r in near_duplicates(made(rows), 2).collect()}
    for i, t, _ in rows:
        w = t.split()
        assert out[i].n_shingles == len({tuple(w[k : k + 2]) for k in range(n - 1)})
    assert [out[i].component_id for i in (1, 2, 3)] == [1, 1, 3]


def test_counts_of_a_long_text(long):
    text = "\n".join(" ".join(long[k : k + 40]) + (" # $" if k % 200 else "") for k in range(0, len(long), 40)) + "\n" + "\n".join([" ".join(long[:40])] * 3)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]
    assert counts(pa.array(["a b", text, None])).tolist()[1] == want


def test_scores_of_long_texts_and_of_nothing(made, long):
    r = np.random.default_rng(3)
    model = (r.normal(size=toxicity.BUCKETS).astype(np.float32), -1.0)
    assert toxicity.toxicity(made([]), model).collect() == []
    words = long + long[:1000]
    (got,) = toxicity.toxicity(made([(1, " ".join(words), "s")]).withColumnRenamed("lang", "score"), model).collect()
    names = sorted(set(words))
    who, bucket = toxicity.subwords(names)
    value = dict(zip(names, np.bincount(who, model[0][bucket]) / np.bincount(who), strict=True))
    mean = sum(value[x] for x in words) / len(words) * len(names) / (len(names) + toxicity.FEW_WORDS)
    assert abs(got.score - 1 / (1 + np.exp(1.0 - mean))) < 1e-5 and got.predicted == int(got.score >= 0.3)


def test_personal_data_at_the_end_of_a_long_text(made, long):
    text = " ".join(long)
    model = pii_model.Tagger()
    (got,) = pii.personal_data(made([(1, text + " mail a.b@c.org or 10.0.0.7", "s")]), model).collect()
    at = len(text) + 6
    want = f"email:{at}:{at + 9},ip:{at + 13}:{at + 21}"
    assert got.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(got.spans.split(","))
