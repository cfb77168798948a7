"""Filter interaction audit against removing documents one by one."""

import itertools
from collections import Counter

import numpy as np
import pytest

from factloom.llm import interactions as I

from .docs import SCHEMA, empty

LABELS = "doc_id long, quality int, toxic int"


def fails(text, first):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * capitals > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": not first,
    }


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = [(i, source or "", fails(text or "", i is None or i == least[text or ""])) for i, text, source in docs]
    out, shapley = [], Counter()
    for part in {p for _, p, _ in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [(i, f) for i, p, f in rows if p == part], []
            for step, name in enumerate(order, 1):
                removed = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                only = sum(f[name] and sum(f.values()) == 1 for _, p, f in rows if p == part)
                shapley[part, name] += len(removed)
                out.append([part, order, step, len(left), len(removed), sum(f[name] for _, f in gone), only, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)])
                gone += removed
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_walk_visits_every_order_once_by_single_swaps():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for i in I.swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(k)))) == 1 + len(list(I.swaps(k)))


def test_shapley_sums_to_all_removed():
    cells = np.random.default_rng(3).integers(0, 9, (16, 3))
    names, values = I.walk(cells, "wxyz")
    assert len(names) == 24
    per_filter = {n[-1]: v[-1, 6] for n, v in zip(names, values, strict=True)}
    assert sum(per_filter.values()) == 24 * (cells[:, 0].sum() - cells[0, 0])


@pytest.fixture(scope="module")
def case():
    words = ["w%d" % i for i in range(90)]
    long = " ".join(words)
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "b"), (3, long, None), (None, long, "a"), (None, long, "b"),
        (4, " ".join(words[:20] * 4), "a"), (5, long.upper(), "b"), (6, long + " #", ""), (7, None, "b"), (8, "", None), (9, "", "b"),
        (10, "x" * 20000, "a"), (11, "É " + long, "a"), (12, "A#\tb\n" * 40, "b"), (12, "A#\tb\n" * 40, "b"), (13, "w1 " * 30000, "a"),
        (0, "A#\tb\n" * 40, "c"), (14, long + " 100%", "c"), (15, "short", "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 0), (7, 0, 1), (12, 1, 1), (None, 1, 1), (99, 1, 1), (5, None, None)]
    return docs, labels


def test_equals_brute_force(spark, case):
    docs, labels = case
    table = spark.createDataFrame([(i, t, "en", s, None, "k", 7) for i, t, s in docs], SCHEMA)
    table = table.withColumnsRenamed({"kept": "mask", "shard": "part", "lang": "digest"}).withColumn("first", table.doc_id)  # clashing names
    found = I.audit(I.flagged(table, spark.createDataFrame(labels, LABELS)))
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, labels)


def test_empty_tables(spark, case):
    none = spark.createDataFrame([], LABELS)
    assert I.audit(I.flagged(empty(spark), none)).count() == 0
    docs, _ = case
    rows = spark.createDataFrame([(i, t, "en", s, None, "k", 7) for i, t, s in docs], SCHEMA)
    assert sorted(tuple(r) for r in I.audit(I.flagged(rows, none)).collect()) == brute(docs, [])
