import hashlib
import random

import numpy as np
import pytest

from factloom.llm import substrings
from factloom.llm.fmindex import FMIndex
from factloom.llm.substrings import WINDOW, substring_dedup

from .docs import SCHEMA, awkward, empty


def brute(rows):
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows})
    first = {}
    for last, i, text in order:
        w = text.encode().split()
        for s in range(len(w) - WINDOW + 1):
            key = tuple(w[s : s + WINDOW])
            first[key] = min(first.get(key, (last, i, s)), (last, i, s))
    out = []
    for r in rows:
        w = (r.text or "").encode().split()
        gone = set()
        for s in range(len(w) - WINDOW + 1):
            if first[tuple(w[s : s + WINDOW])] < (r.doc_id is None, r.doc_id or 0, s):
                gone |= set(range(s, s + WINDOW))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(map(str, out))


def passages(spark):
    rng = random.Random(8)
    shared = [[f"p{rng.randrange(9)}q{rng.randrange(40)}" for _ in range(rng.choice([19, 20, 21, 33, 80]))] for _ in range(6)]
    rows = []
    for i in range(70):
        own = [f"u{rng.randrange(500)}" for _ in range(rng.randrange(0, 40))]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(0, 5)
            at = rng.randrange(len(own) + 1)
            own[at:at] = p[cut:]
        rows.append((5000 - i, " ".join(own)))
    hot = [f"h{i}" for i in range(45)]
    rows += [(6000 + i, f"a{i} b{i % 7} " + " ".join(hot[i % 3 :]) + f" c{i} d{i}") for i in range(40)]
    rows += [(None, rows[3][1]), (None, " ".join(hot)), (7000, " ".join(hot + hot))]
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("hot,hot_all,flush", [(256, 4096, 1_000_000), (2, 3, 50), (3, 100, 1_000_000), (256, 2, 60)])
def test_matches_brute_force(spark, monkeypatch, hot, hot_all, flush):
    for name, value in (("HOT", hot), ("HOT_ALL", hot_all), ("FLUSH", flush)):
        monkeypatch.setattr(substrings, name, value)
    docs = passages(spark).unionByName(awkward(spark, n=30, vocab=4))
    got = substring_dedup(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs.collect())
    assert sum(r.n_removed for r in got) > 1000


def test_backward_search_counts_and_places():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 5, 399), 0)
    index = FMIndex(text, 12)
    ends = np.arange(1, 400)
    for least in (1, 2):
        length, low, high = index.statistics(ends, text, 12, least)
        for e, n, a, b in zip(ends, length, low, high, strict=True):
            count = lambda m: sum((text[i : i + m] == text[e - m : e]).all() for i in range(401 - m))  # noqa: B023,E731
            assert count(n) >= least and (n == min(12, e) or count(n + 1) < least)
            if n:
                assert b - a == count(n)
                assert index.first(np.array([a]), np.array([b]))[0] == next(i for i in range(400) if (text[i : i + n] == text[e - n : e]).all())


def test_empty(spark):
    assert substring_dedup(empty(spark)).count() == 0


def test_many_buckets_a_task(spark, monkeypatch):
    """The same rows whatever the number of buckets and shards."""
    docs = awkward(spark, n=60, seed=4)
    want = sorted(map(str, substring_dedup(docs).collect()))
    for size in (50, 700):
        monkeypatch.setattr(substrings, "BUCKET_BYTES", size)
        assert sorted(map(str, substring_dedup(docs).collect())) == want
