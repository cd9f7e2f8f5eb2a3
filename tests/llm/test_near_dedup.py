import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.components import components
from tessera.llm.near_dedup import REGISTERS, estimate, near_duplicates, registers
from tessera.llm.textkit import U


def brute(rows, size):
    """n_shingles by row and component by set, over rows (doc_id, text)."""
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    reps = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None and s:
            reps[s] = min(i, reps.get(s, i))
    parent = {i: i for i in reps.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(reps)
    for a, s in enumerate(keys):
        for t in keys[:a]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(reps[s]), find(reps[t])
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), None if i is None else find(reps[s]) if s else i) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(made, corpus, size):
    out = near_duplicates(made(corpus).withColumnRenamed("lang", "component_id").withColumnRenamed("n_chars", "kept"), size).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out) == brute([(i, t) for i, t, _ in corpus], size)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_chain_of_copies_crosses_components(made):
    """A chain whose ends are unlike each other is one component."""
    words = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words), "s"))
        words[3 * i] = f"new{i}"
    out = near_duplicates(made(rows), 2).collect()
    assert {r.component_id for r in out} == {0}
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out) == brute([(i, t) for i, t, _ in rows], 2)


def test_empty_table(made):
    assert near_duplicates(made([])).collect() == []


def test_estimate_is_near_the_similarity():
    r = np.random.default_rng(0)
    for n, share in ((5000, 0.8), (2000, 0.5), (300, 0.9)):
        both = r.integers(0, 1 << 64, n, dtype=U)
        common = int(n * 2 * share / (1 + share))
        a, b = np.unique(both), np.unique(np.concatenate([both[:common], r.integers(0, 1 << 64, n - common, dtype=U)]))
        agree = (registers(a) == registers(b)).sum()
        assert abs(estimate(agree, n, n) - share) < 0.15
    assert len(registers(np.array([7], U))) == REGISTERS


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    parent = defaultdict(lambda: None)

    def find(x):
        while parent[x] is not None:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
