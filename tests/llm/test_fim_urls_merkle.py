"""Fill-in-the-middle, URL filters and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as fim
from tessera.llm import merkle as mk
from tessera.llm import url_filter as uf


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+$", text)
    parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    lead = text[: len(text) - sum(map(len, parts))]
    return [lead + parts[0], *parts[1:]] if parts else [text] * bool(text)


def brute_fim(i, text, unit):
    text = text or ""
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units(text, unit)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(u), "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fim_against_brute_force(made, corpus, unit):
    rows = [*corpus, (70, "a<P>b", "s"), (71, "< P><S", "s"), (72, "éü\n漢字 \n\n𝔘x\u3000y", "s"), (73, "  lead and trail \n ", "s"), (74, "<S" * 5 + "<", "s"), (75, "漢" * 400_000, "s")]
    rows += [(k, t, "s") for k, t in zip(range(100, 160), ["x y z <S é"] * 60, strict=True)]
    docs = made(rows).withColumnRenamed("lang", "form").withColumnRenamed("n_chars", "fim_bytes")
    out = fim.fill_in_middle(docs, unit=unit).withColumn("back", fim.restored(F.col("fim_text"), F.col("form"))).collect()
    got = sorted(str((str(r.doc_id), r.n_units, r.form, r.prefix_units, r.middle_units, r.fim_text)) for r in out)
    assert got == sorted(str((str(i), *brute_fim(i, t, unit))) for i, t, _ in rows)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t, _ in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in out}
    assert fim.fill_in_middle(made([])).collect() == []


def test_select():
    r = random.Random(3)
    for _ in range(300):
        bits = [r.random() < r.choice([0.05, 0.5, 1]) for _ in range(r.randint(1, 200))]
        x = int("".join("01"[b] for b in bits), 2)
        assert [fim.select(x, len(bits), k + 1) for k in range(sum(bits))] == [i for i, b in enumerate(bits) if b]


def brute_url(url, rules, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[2]
    named = any(host == h or host.endswith("." + h) for h in listed if h)
    return host, path, None, "block" if named else "allow"


@pytest.mark.parametrize("parts", [1, 3])
def test_urls_against_brute_force(spark, monkeypatch, parts):
    r = random.Random(8)
    label = lambda: r.choice(["a", "b", "shop", "x-y", "com", "net", "org", "example"])
    hosts = [".".join(label() for _ in range(r.randint(1, 5))) for _ in range(600)]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{h.upper() if r.random() < 0.1 else h}{r.choice(['', '/', '/en/1', '/es/2?q=/fr/', '?x', '#://b.com/', '/EN/3', '//'])}" for h in hosts]
    urls += [None, "", "no host", "://", "http://", "http://com", "http://com/", "http://.com/", "http://com./", "http://a..com/", "x://é.com/ü?", "http://www.example.com/en/" + "z" * 100_000, "http://" + "a." * 3000 + "net/fr/", "http://com:80/"] + urls[:5] * 3
    rules = [*uf.RULES, ("b.com", "/", "block"), ("com", "/e", "block"), ("shop", "", "allow"), ("a", "/en/", "allow"), ("a", "/en/", "block")]
    listed = sorted({*r.sample(hosts, 60), "x-y", "unseen.org"}) + ["", "x-y"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    if parts > 1:
        monkeypatch.setattr(uf, "FILTER_BYTES", 60)
        monkeypatch.setattr(uf.Cascade, "bytes", 0)
        monkeypatch.setattr(uf, "CHUNK_WORDS", 2)
    names = spark.createDataFrame([(h,) for h in [*listed, None]], "host string")
    out = uf.url_filter(pages, names, rules, keep=["page_id", "verdict"]).collect()
    assert [(x.host, x.path, x.rule, x.verdict) for x in sorted(out)] == [brute_url(u, rules, listed) for u in urls]
    none = spark.createDataFrame([], "host string")
    assert [x.verdict for x in uf.url_filter(pages.limit(3), none, []).collect()] == ["allow"] * 3
    assert [x.rule for x in uf.url_filter(pages.where("url = 'http://com/'"), none, uf.RULES).collect()] == ["com/"]
    assert uf.url_filter(pages.limit(0), names, rules).collect() == []


def test_cascade_is_exact(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = keys.where("key like '%7'")
    cascade = uf.Cascade(listed.unionByName(spark.createDataFrame([("outside",)], "key string")), keys)
    wrong = keys.select("key", cascade.has(F.col("key")).alias("has")).where("has <> (key like '%7')")
    assert wrong.count() == 0 and len(cascade.levels) > 3 and cascade.bytes < 10_000


def brute_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def brute_merkle(rows, other):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, made(r, r[1]), made(r, other(r))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    forest = brute_tree([trees[s][-1][0] for s in names])
    out = []
    for p, s in enumerate(names):
        for k, (there, i, leaf, changed) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            h, proof = changed, ""
            for levels, at in ((trees[s], k), (forest, p)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    proof += "".join(run[: at % 3] + run[at % 3 + 1 :])
                    h = sha("".join(run[: at % 3] + [h] + run[at % 3 + 1 :]))
                    at //= 3
            out.append((i if there else None, leaf, trees[s][-1][0], forest[-1][0], sha(proof), h, h == forest[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_merkle_against_brute_force(spark, corpus, monkeypatch, depth):
    monkeypatch.setattr(mk, "DEPTH", depth)
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus] + [(k, f"text\n{k}", None, "big", None) for k in range(200, 300)] + [(7, "once\nmore", "xx", f"é{k}", 1) for k in range(20)]
    rows += [(5, "the same", "en", "copies", 1)] * 30 + [(None, "no id", None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tree", F.lit(1)).withColumn("hash", F.lit("x"))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = mk.merkle(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))).collect()
    other = lambda r: r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
    assert sorted(str(tuple(r)) for r in out) == brute_merkle(rows, other)
    assert {r.verified for r in out} == {True, False}


def test_merkle_of_little(made):
    assert mk.merkle(made([])).collect() == []
    (one,) = mk.merkle(made([(1, "t", "s")])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:11:s2:en1:11:t") and one.proof_sha256 == sha("") and one.verified
