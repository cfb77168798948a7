import random
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import jaccard
from factloom.llm.graph import components
from factloom.llm.jaccard import Forest, Join, jaccard_join

from .docs import SCHEMA, awkward, empty


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    forest = Forest()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and Fraction(len(x & y), len(x | y)) >= Fraction(num, den):
                forest.join(a, b)
    return sorted(str((d, len(s), None if d is None else forest.root(d))) for d, s in sets)


def near(spark):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        words = [f"{rng.choice('abcdef')}{rng.randrange(60)}" for _ in range(rng.choice([4, 12, 40, 150, 400]))]
        for _ in range(9):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(999)}"
            rows.append(" ".join(own))
    rows += rows[:30]
    rng.shuffle(rows)
    return spark.createDataFrame([(1000 + i, t, None, None, None, None, None) for i, t in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("n,num,den,paired", [(3, 90, 100, 8), (5, 80, 100, 32), (3, 80, 100, 2), (3, 90, 100, 2)])
def test_matches_brute_force(spark, monkeypatch, n, num, den, paired):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    docs = awkward(spark, n=60, vocab=6).unionByName(near(spark))
    want = brute(docs.collect(), n, num, den)
    got = sorted(str(tuple(r)) for r in jaccard_join(docs, n, num, den).collect())
    assert got == want


@pytest.mark.parametrize("num", [70, 90])
def test_large_clusters_in_blocks(spark, monkeypatch, num):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "FRAGMENT", 16)
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    docs = near(spark)
    got = sorted(str(tuple(r)) for r in jaccard_join(docs, 3, num, 100).collect())
    assert got == brute(docs.collect(), 3, num, 100)


@pytest.mark.parametrize("num", [70, 80, 90])
def test_linked_sets_share_enough(num):
    rng, join = np.random.default_rng(3), Join(3, num, 100)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(2, 300))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        cut = int(rng.integers(0, max(1, n * (100 - num) // 100) + 1))
        y = np.concatenate([x[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, cut + 1)), dtype=np.uint64) * np.uint64(2)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= num * (len(x) + len(y) - both):
            linked += 1
            sign, owner = join.signs([x, y, x[:0]])
            shared = np.intersect1d(sign[owner == 0], sign[owner == 1]) & np.uint64(127)
            counts = np.bincount(shared.astype(int), minlength=128)
            assert any(n >= join.needed(c) for c, n in enumerate(counts))
    assert linked > 1000


def test_components(spark):
    rng = random.Random(6)
    for edges in ([(2, 56)], [(5, 3), (3, 9), (1, 2)], [(i, i + 1) for i in range(40)], [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], [(0, i) for i in range(50)]):
        forest = Forest()
        for a, b in edges:
            forest.join(a, b)
        want = {v: forest.root(v) for a, b in edges for v in (a, b) if a != b}
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.v: r.component for r in got} == want and len(got) == len(want)


def test_empty(spark):
    assert jaccard_join(empty(spark)).count() == 0
