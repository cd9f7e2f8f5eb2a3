"""Decontamination, mixing and sharding."""

import re
from collections import Counter, defaultdict

from tessera.llm.decontaminate import contamination
from tessera.llm.mixing import mixture
from tessera.llm.sharding import shards


def split(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(str(i) if i is not None else "null")
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def test_contamination_against_brute_force(spark, made, corpus):
    texts = {i: t for i, t, _ in corpus}
    long = texts[12].split()
    items = [(1, " ".join(long[50:75])), (2, " ".join(long[60:71])), (3, " ".join(long[100:104]).upper()), (4, "ha"), (5, "ha ha, ha! ha ha ha ha ha ha ha ha ha"), (None, " ".join(long[5:15])), (6, None), (7, " -- "), (2, "unseen words in this item here and there and nowhere else"), (8, " ".join(texts[60].split()[-10:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, t) for i, t, _ in corpus]
    docs.append((99, "x " + " ".join(long[50:58]) + " y " + " ".join(long[66:76])))
    out = contamination(made([(i, t, "s") for i, t in docs]).withColumnRenamed("lang", "n_hit"), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in out) == brute_hits(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in out)


def test_contamination_of_nothing(spark, made):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(made([]), bench).collect() == []
    assert [r.n_hit for r in contamination(made([(1, "a b c", "s")]), bench).collect()] == [0]


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float((3, 1, 2)[k % 3]) for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(made, corpus):
    docs = made(corpus).withColumnRenamed("lang", "mix_taken").withColumnRenamed("n_chars", "mix_key")
    out = mixture(docs).collect()
    assert len(out) == len(corpus)
    sizes, taken = Counter(), Counter()
    for r in out:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.mix_taken <= 2 * r.mix_size
        sizes[r.source] += r.mix_size
        taken[r.source] += r.mix_taken
    target = water_fill(sizes)
    for r in out:
        assert abs(r.mix_target - target[r.source]) < 1e-6 and r.mix_source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in sizes)
    key = lambda rows: sorted(map(str, rows))
    assert key(out) == key(mixture(docs.repartition(7)).collect())
    assert mixture(made([])).collect() == []
    assert [r.mix_taken for r in mixture(made([(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_sharding(made, corpus):
    rows = corpus + [(i, f"text {i}", "big") for i in range(1000, 1500)]
    out = shards(made(rows).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "sh_source")).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(16))
    per = Counter((r.source, r.shard) for r in out)
    for s in {r.source for r in out}:
        counts = [per[s, k] for k in range(16)]
        assert max(counts) - min(counts) <= 2
    assert shards(made([])).collect() == []
    assert sorted(r.slot for r in shards(made(rows[:3])).collect()) == [0, 0, 0]


def test_places_of_repeated_ids_do_not_depend_on_the_order_of_rows(made):
    rows = [(k % 7, f"text {k}", "s") for k in range(300)] + [(None, f"none {k}", None) for k in range(50)]
    key = lambda out: sorted((str(r.doc_id), r.text, r.shard, r.slot) for r in out.collect())
    assert key(shards(made(rows))) == key(shards(made(rows[::-1]).repartition(5)))
