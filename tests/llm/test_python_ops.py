"""Archives, repeated strings, token counts, quality rules, toxicity and personal data."""

import base64
import gzip
import hashlib
import io
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import pii, pii_model, toxicity
from tessera.llm.common import scratch_path
from tessera.llm.quality import counts, host_rates, verdicts
from tessera.llm.runindex import RunLengthIndex
from tessera.llm.substring_dedup import repeats_removed
from tessera.llm.textkit import PIECE
from tessera.llm.token_counts import _counter, cutting, default_path, split_safely, token_counts
from tessera.llm.warc import members, parsed, read_archive, record, write_archive

PAGES = [(1, "http://a/ b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 70000), (None, "http://f", "<p>x</p>"), (None, "http://g", "only"), (0, "http://h", "WARC/1.1\r\n\r\n"), (6, "u", "<p>x</p>"), (6, "u", "<p>x</p>")]


def expected_pages(pages, least):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= least and i != first.get(h or "")
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first.get(h or "") if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "split"), [(0, 1 << 20), (0, 100), (5, 700)])
def test_archive_round_trip(spark, least, split):
    where = scratch_path(spark, "test-warc")
    manifest = write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), where, least)
    out = read_archive(manifest, where, split).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == expected_pages(PAGES, least)
    for m in manifest.where("records > 0").collect():
        assert gzip.open(m.path).read().startswith(b"WARC/1.1\r\n")


def test_members_are_owned_once_whatever_the_ranges():
    payloads = [random.Random(k).randbytes(k * 50) + b"\x1f\x8b\x08" * k for k in range(30)]
    raw = b"junk\x1f\x8b\x08more" + b"".join(record(k, "u", p, "D", None, False) for k, p in enumerate(payloads))
    for step in (37, 500, 10_000, len(raw)):
        got = [parsed(r)[1].partition(b"\r\n\r\n")[2] for a in range(0, len(raw), step) for _, r in members(io.BytesIO(raw), a, min(a + step, len(raw)))]
        assert got == payloads


def test_long_headers_are_read():
    r = random.Random(4)
    urls = ["http://x/" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (3_000_000, 20, 200_000)]
    raw = b"".join(record(k, u, b"payload", "D", None, False) for k, u in enumerate(urls))
    for step in (500_000, len(raw)):
        got = [parsed(m)[0]["warc-target-uri"] for a in range(0, len(raw), step) for _, m in members(io.BytesIO(raw), a, min(a + step, len(raw)))]
        assert got == urls


def test_empty_archive(spark):
    where = scratch_path(spark, "test-warc")
    assert read_archive(write_archive(spark.createDataFrame([], "page_id long, url string, html string"), where), where).collect() == []


def test_run_length_index_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(40):
        base = bytes(r.integers(97, 97 + r.integers(1, 4), r.integers(1, 30)).astype(np.uint8))
        texts = [(base * 2)[: r.integers(0, 2 * len(base) + 1)] for _ in range(r.integers(1, 6))]
        places = [(t, t[j:]) for t in texts for j in range(len(t) + 1)]
        best = []
        for n, (_, s) in enumerate(places):
            common = [next((k for k in range(min(len(s), len(u))) if s[k] != u[k]), min(len(s), len(u))) for m, (_, u) in enumerate(places) if m != n]
            best.append(max(common, default=0))
        index = RunLengthIndex(texts)
        assert index.matching_statistics().tolist() == best
    assert RunLengthIndex([b"abcabcabc" * 50]).runs < 40


def brute_repeats(rows, n):
    seen = Counter(b[s : s + n] for b in (((t or "").encode()) for _, t, _ in rows) for s in range(len(b) - n + 1))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = set()
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone |= set(range(s, s + n))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        out.append((str(i), len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def brute_passages(rows, most):
    """The (doc_id, text) pairs that share more than `most` words in a row with another pair."""
    seen = {}
    pairs = {(i, t) for i, t, _ in rows}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - most):
            seen.setdefault(tuple(w[k : k + most + 1]), set()).add((i, t))
    return {p for ps in seen.values() if len(ps) > 1 for p in ps}


@pytest.mark.parametrize("index_bytes", [1 << 20, 1500, 300])
def test_repeats_against_brute_force(made, corpus, index_bytes):
    rows = [(i, (t or "")[:4000] if t else t, s) for i, t, s in corpus]
    out = repeats_removed(made(rows).withColumnRenamed("lang", "n_bytes"), 100, 20, index_bytes).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) for r in out) == brute_repeats(rows, 100)
    assert repeats_removed(made([])).collect() == []


def test_shared_passages_against_brute_force(made, corpus):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    passage = [" ".join(word() for _ in range(n)) for n in (50, 51, 55)]
    rows = [*corpus, *[(100 + k, " ".join([*(word() for _ in range(r.randint(0, 90))), passage[k % 3], *(word() for _ in range(r.randint(0, 90)))]), "s1") for k in range(12)]]
    rows += [(200, " ".join([passage[1]] * 3), "s1"), (201, " ".join(["x" + word() for _ in range(30)] * 9), "s1")]
    found = {(r.doc_id, r.n_bytes) for r in repeats_removed(made(rows)).where("shared_passage").collect()}
    assert found == {(i, len(t.encode())) for i, t in brute_passages(rows, 50)}
    assert {i for i, _ in found} >= {101, 102, 104, 200} and not {i for i, _ in found} & {100, 103, 201}


def test_regular_strings_are_told_apart():
    """Thue-Morse words collide under any polynomial hash modulo a power of two."""
    from tessera.llm.near_dedup import shingle_sets
    from tessera.llm.textkit import Spans

    for bits in (10, 11, 12):
        a = bytes(97 + k.bit_count() % 2 for k in range(1 << bits))
        b = a.translate(bytes.maketrans(b"ab", b"ba"))
        buf = np.frombuffer(a + b, np.uint8)
        h = Spans(buf)(np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert h[0] != h[1]
        assert counts(pa.array([f"{a.decode()}\n{b.decode()}"])).tolist()[0][3] == 0
        x, y = shingle_sets(pa.array([a.decode(), b.decode()]), 2)
        assert x[0] != y[0]
        assert not RunLengthIndex([a[:600] + b"1", b[:600] + b"2"]).repeated_starts(500)[0]


@pytest.mark.parametrize("length", [1024, 2048])
def test_regular_strings_stay(made, length):
    a = "".join("ab"[k.bit_count() % 2] for k in range(length))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a + " x", "s"), (2, b + " y", "s"), (3, "z " + a + " x", "s")]
    out = repeats_removed(made(rows), 900, 64).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) for r in out) == brute_repeats(rows, 900)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(made, corpus, name):
    path = default_path(name)
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdéß1'-.") for _ in range(r.randint(1, 9))) + r.choice(["", "", " ", "\n", "\t "]) for _ in range(300_000))
    assert len(long) > PIECE
    rows = [*corpus, (70, "<|endoftext|> it's <|startoftext|>x " * 3000, "s"), (71, "é " * 50_000 + "a" * 70_000, "s"), (72, "A ́b é   c " * 20_000, "s"), (73, long, "s"), (74, "a  b c 1 2\u3000x y z's " * 9000, "s"), (75, " " * 70_000 + "x", "s")]
    count = _counter(path)
    out = token_counts(made(rows).withColumnRenamed("lang", "n_tokens"), path, keep=("doc_id", "text", "n_tokens")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == sorted((str(i), len((t or "").encode()), count([t or ""])[0]) for i, t, _ in rows)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    assert token_counts(made([]), path).collect() == []


def test_where_texts_are_cut(tmp_path):
    """The tokenizer's own steps decide, whatever the file is called."""
    made = json.load(open(default_path("word_bpe_49k.json")))
    (tmp_path / "renamed.json").write_text(json.dumps(made))
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] += r"|\s"
    (tmp_path / "word_with_spaces.json").write_text(json.dumps(made))
    found = [cutting(str(tmp_path / "renamed.json")), cutting(str(tmp_path / "word_with_spaces.json")), *(cutting(default_path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))]
    assert found == ["white", None, "before", "drop"]
    raw = ("word " * 40_000).encode()
    assert b"".join(split_safely(raw, "before")) == raw and len(split_safely(raw, "before")) > 2
    assert b" ".join(split_safely(raw, "drop")) == raw and split_safely(raw, None) == [raw]


def test_quality_counts_against_brute_force(corpus):
    texts = [t for _, t, _ in corpus] + ["a b c\na b c\n\n\n \nx a b c", "# $x #\r\n" * 3, "\n".join(["same line"] * 60)]
    for row, t in zip(counts(pa.array(texts)).tolist(), texts, strict=True):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert row == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)]


def test_hosts_are_rejected_by_shrunk_rates(made):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(i, good + f" end{i}", "fine") for i in range(60)] + [(100 + i, "short", "bad") for i in range(58)] + [(200, good, "bad"), (201, good, None), (300, "short", "tiny"), (301, good, "tiny")]
    out = {r.doc_id: r for r in verdicts(made(rows).withColumnRenamed("lang", "kept")).collect()}
    assert all(out[i].kept for i in range(60)) and not out[200].kept and out[201].kept and out[301].kept and not out[300].kept
    assert out[200].host_rate > 0.6 > out[301].host_rate
    assert verdicts(made([])).collect() == []


def test_host_limits_come_from_the_other_hosts(spark):
    """Hosts that fail at about the same rate stay; one far beyond the others goes, long before most of it fails."""
    like = [(f"h{i}", 1000, 90 + 3 * (i % 10)) for i in range(20)]
    rates = lambda rows: {r.host: r for r in host_rates(spark.createDataFrame(rows, "host string, n long, k long")).collect()}
    same = rates(like)
    assert all(r.rate <= r.limit < 0.3 for r in same.values())
    odd = rates([*like, ("odd", 1000, 300), ("few", 2, 2)])
    assert odd["odd"].rate > odd["odd"].limit and odd["few"].rate < odd["few"].limit
    assert all(r.rate <= r.limit for h, r in odd.items() if h != "odd")
    alone = rates([("one", 10, 7)])["one"]
    assert alone.rate == 0.7 and alone.limit == 0.6


def test_bad_host_loses_its_good_documents(made):
    good = lambda i: " ".join(f"word{k}x{i}" for k in range(60))
    rows = [(1000 * h + i, "short" if i % 10 == 0 or (h == 7 and i % 2) else good(i), f"h{h}") for h in range(8) for i in range(100)]
    out = verdicts(made(rows)).collect()
    assert {r.source for r in out if not r.kept and not r.base_failed} == {"h7"}
    assert not any(r.kept for r in out if r.source == "h7")


def test_toxicity_is_learnt(spark, made):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(3))

    def text(bad, known):
        ws = [word() for _ in range(60)]
        if bad:
            for k in (5, 20, 40):
                ws[k] = r.choice(["grobnik", "grobnak", "zworst", "zworsty"] if known else ["grobnuk", "zworsta"])
        return " ".join(ws)

    rows = [(i, text(i % 3 == 0, True), "s") for i in range(600)]
    labels = [(i, int(i % 3 == 0)) for i in range(600)]
    model = toxicity.fit(made(rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, label int"))
    test = [(i, text(i % 2, i % 4 == 1), "s") for i in range(200)] + [(1000, None, "s"), (1001, "", "s")]
    out = {x.doc_id: x for x in toxicity.toxicity(made(test), model).collect()}
    assert sum(out[i].predicted == i % 2 for i in range(200)) > 180
    assert sum(out[i].predicted for i in range(3, 200, 4)) > 40
    assert out[1000].score == out[1001].score and all(0 <= x.score <= 1 for x in out.values())
    none = toxicity.fit(made(rows), spark.createDataFrame([], "doc_id long, label int"))
    assert {x.predicted for x in toxicity.toxicity(made(test), none).collect()} == {0}


@pytest.mark.parametrize("toxic", [3, 7])
def test_rare_toxic_labels_still_train(toxic):
    r = random.Random(3)
    words = lambda: " ".join("".join(r.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(3)) for _ in range(60))
    # no toxic row is a fifth one
    labels = [int(i % 5 == 0 and i < 5 * toxic) for i in range(200)]
    weights, constant = toxicity.train([words() + " grobnik grobnak" * y for y in labels], labels, toxic / 200)
    found = lambda tail: (1 / (1 + np.exp(-toxicity._logits([words() + tail for _ in range(50)], weights) - constant)) >= toxicity.THRESHOLD).sum()
    assert found(" grobnik grobnak" * 3) > 25 > 5 > found("")


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_patterns_against_the_plain_ones(made):
    r = random.Random(1)
    texts = ["".join(r.choice("ab@.1 +-(5)é") for _ in range(400)) for _ in range(60)] + ["a@b.c@d.e x@@y.z 001.2.3.4 1.2.3.4.5 256.1.1.1 4111 1111 1111 1111 +1 (555) 555-1234.", None, "", "1" * 5000]
    out = pii.personal_data(made([(i, t, "s") for i, t in enumerate(texts)]).withColumnRenamed("lang", "spans")).collect()
    for row in out:
        want = brute_spans(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(row.spans.split(","))
        assert row.n_ip == want.count("ip:") and row.n_email == want.count("email:")


def test_tagger_on_held_out_sentences():
    model = pii_model.trained()
    examples = pii_model.labelled_spans(np.random.default_rng(77), 300)
    x, lengths, tags = pii_model.batch_of(examples, 160)
    got = model.decode(x, lengths)
    on = np.arange(160) < lengths[:, None]
    assert (got == tags)[on].mean() > 0.98 and (got == tags)[on & (tags > 0)].mean() > 0.94
    text = "call (415) 555-0134 now " + "word " * 100 + "or 415-555-0199, not 2024-01-05"
    held = pii.Tags(model)
    held.add(0, text)
    held.flush()
    found = {text[a:b] for _, a, b in pii.merged(text, [], held.spans(0))}
    assert {"(415) 555-0134", "415-555-0199"} <= found and "2024-01-05" not in found


def test_long_addresses_are_read_whole():
    class Everything:
        """Tags every character that it is shown as part of an email."""

        def decode(self, x, lengths):
            return np.full(x.shape, 2)

    for text in ("bob @ mathematics.stanford-university.edu", "extraordinarily_long_name_of_somebody @ x.org", "a" * 300 + " @ " + "b" * 300 + ".org"):
        held = pii.Tags(Everything())
        held.add(0, text)
        held.flush()
        assert pii.merged(text, [], held.spans(0)) == [(0, 0, len(text))]


def test_gradients_of_the_tagger():
    model, r = pii_model.Tagger(), np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, lengths, tags = pii_model.batch_of(pii_model.labelled_spans(r, 3), 24)
    _, grads = model.loss_grads(x, lengths, tags)
    for k in ("xf", "hb", "trans", "out", "first", "bb"):
        at = tuple(int(r.integers(0, s)) for s in model.p[k].shape)
        old, losses = model.p[k][at], []
        for e in (1e-2, -1e-2):
            model.p[k][at] = old + e
            losses.append(model.loss_grads(x, lengths, tags)[0])
        model.p[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 / 3 - grads[k][at]) < 1e-3


def test_windows_of_a_long_text_are_covered_once():
    from tessera.llm.substring_dedup import PART, _occurrences

    text = "".join(random.Random(1).choices("abcdef ", k=2 * PART + 1234))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], names=["doc_id", "tk", "text"])
    spans = sorted((r["lo"], r["hi"]) for out in _occurrences(400, 64)(iter([batch])) for r in out.to_pylist())
    assert spans[0][0] == 0 and spans[-1][1] == len(text) - 400
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_secrets_are_added_in_unseen_documents(made):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["en", "th", "er", "ti", "ra", "lo", "ouï", "ñez"]) for _ in range(r.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    code = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    hexa = "0123456789abcdef"
    makers = [lambda: ("", "AKIA" + code("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)), lambda: ("password=", code(hexa, 18)), lambda: ('token = "', code(hexa, 40))]
    rows, want = [], {}
    for i in range(120):
        before, value = makers[i % 3]()
        text = f"{words(r.randint(3, 60))} {before}"
        want[i] = f"secret:{len(text)}:{len(text) + len(value)}"
        rows.append((i, text + value + ('"' if '"' in before else "") + f" {words(r.randint(3, 60))}", "s"))
    rows += [(1000 + i, f"{words(30)} Licensed under CC BY-NC 4.0.\\n{words(5)} version 3.{i} {words(20)}", "s") for i in range(60)] + [(2000 + i, words(60), "s") for i in range(40)]
    out = {x.doc_id: x for x in pii.personal_data(made([*rows, (3000, None, "s"), (3001, "", "s")])).collect()}
    assert sum(want[i] in out[i].spans.split(",") for i in range(120)) > 108
    assert all(x.private == (x.spans != "") and x.n_added == len([s for s in x.spans.split(",") if s]) for x in out.values())
    assert sum(x.n_added for i, x in out.items() if i >= 1000) <= 2
    assert not any(out[i].private for i in (*range(2000, 2040), 3000, 3001))
    assert pii.personal_data(made([])).collect() == []


def test_long_runs_of_code_are_read_once():
    import time

    from tessera.llm import pii

    text = "key " + "aB3" * 400_000 + " end ab12 " + "x" * 20
    n = text.index(" end")
    tagged = [(4, k, k + 1) for k in range(4, n, 2)] + [(4, n + 5, n + 6)]
    began = time.perf_counter()
    assert pii._whole_secrets(text, tagged) == [(4, 4, n)]
    assert pii.merged(text, [(0, 0, 3)], tagged) == [(0, 0, 3), (4, 4, n)] and time.perf_counter() - began < 10
    base = [(1, 0, 9), (2, 4, 30), (0, 12, 15)]
    words = "123456789 0123 56 89012345678 abcdefgh12 99"
    assert (4, 30, 40) in pii.merged(words, base, [(4, 30, 40)]) and (4, 25, 40) not in pii.merged(words, base, [(4, 25, 40)])


def test_training_and_scoring_split_words_alike():
    from tessera.llm import toxicity

    texts = ["hund\u3000katze\u3000maus ja", "hund\u3000katze\u3000maus nein", "a\u00a0b\x85c\x1cd e\x0bf", "a\u00a0b\x85c\x1cd"]
    assert set(toxicity._bags(texts)[3]) == {"hund\u3000katze\u3000maus", "a\u00a0b\x85c\x1cd"}
