import random
from collections import Counter

import numpy as np
import pyarrow as pa

from factloom.llm.common import Texts
from factloom.llm.quality import BITS, BUCKETS, NGRAM, UNIT, base_rules, log_ratio, quality, scored

from .docs import awkward, empty


def brute(text):
    text = text or ""
    w = text.encode().split()
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in text), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_base_counts():
    rng = random.Random(1)
    parts = ["a", "bc", "é", " ", "\n", "\t", "#", "$", " ", "d e f", "\x0b", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 90))) for _ in range(400)] + [None, "", " ", "x", "a b c " * 40]
    got = base_rules(pa.array(texts), Texts(pa.array(texts)))
    assert list(zip(*(x.tolist() for x in got.values()), strict=True)) == [brute(t) for t in texts]


def labels(spark, docs):
    rows = [(r.doc_id, 1 if (r.text or "").count("w1") > 1 else 0, 0) for r in docs.collect() if r.doc_id is None or r.doc_id % 2 == 0]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_match_brute_force(spark):
    docs = awkward(spark)
    marks = labels(spark, docs)
    trusted = {r.doc_id for r in marks.collect() if r.quality == 1 and r.doc_id is not None}
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    grams = {}
    for i, r in enumerate(docs.collect()):
        data = (r.text or "").encode()
        keys = [int.from_bytes(data[j : j + NGRAM], "big") for j in range(len(data) - NGRAM + 1)]
        buckets = np.array([(k * 2654435761 % (1 << 32)) >> (32 - BITS) for k in keys], int)
        grams[i] = buckets
        np.add.at(raw, buckets, 1)
        if r.doc_id in trusted:
            np.add.at(target, buckets, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.array_equal(np.rint(ratio * UNIT), log_ratio(docs, marks))
    ratio = np.rint(ratio * UNIT) / UNIT
    want = sorted((str(r.doc_id), round(float(ratio[grams[i]].mean()), 9) if len(grams[i]) else 0.0) for i, r in enumerate(docs.collect()))
    rows = quality(docs, marks, threshold=0.01).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in rows) == want
    assert all(r.kept == (not r.base_failed and r.score >= 0.01) for r in rows)


def test_no_labels_and_empty(spark):
    docs = awkward(spark)
    none = labels(spark, docs).where("quality = 5")
    assert all(r.score == 0 for r in quality(docs, none).collect())
    assert quality(empty(spark), none).count() == 0


def test_junk_is_told_from_prose(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 5)))
    vocabulary = [word() for _ in range(300)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(200)]
    bad = [" ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(120)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 230, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality(docs, marks).collect() if r.kept}
    assert kept == set(range(200))


def test_score_does_not_depend_on_the_batch(spark):
    import pyarrow as pa

    texts = [r.text for r in awkward(spark).collect()]
    ratio = np.random.default_rng(1).integers(-(1 << 26), 1 << 26, BUCKETS)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    whole = pa.Table.from_batches(scored(iter([batch]), ratio, 0.0)).to_pylist()
    parts = pa.Table.from_batches(scored(iter([batch.slice(i, 7) for i in range(0, len(texts), 7)]), ratio, 0.0)).to_pylist()
    assert whole == parts


def test_verdict_on_held_out_labels(spark):
    """Fitted without the labels of a fifth of the documents, what is kept of that fifth is mostly good, and hardly anything good goes."""
    from pyspark.sql import functions as F

    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id") % 5 == 0
    rows = quality(docs, marks.where(~held)).join(marks.where(held).select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert len(good) > 20 and sum(good) / len(good) > 0.95
    assert len(bad) > 5 and sum(bad) / len(bad) < 0.1
