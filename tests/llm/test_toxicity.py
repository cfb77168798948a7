import random

import numpy as np
import pyarrow as pa

from factloom.llm.common import Texts
from factloom.llm.toxicity import fit, parted, sentences, toxicity

from .docs import awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=900):
    rng = random.Random(7)
    stems = ["grobl", "vexur", "idjit"]
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 160))]
        words = [w + ("." if rng.random() < 0.12 else "") for w in words]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["", "en", "ost", "ly", "x"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)


def test_held_out_accuracy_and_place(spark):
    docs, marks = corpus(spark)
    rows = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert 150 < len(held) < 300
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [r for r in held if r.predicted and r.doc_id % 5 == 0]
    assert all(any(any(s in x.lower() for s in ("grobl", "vexur", "idjit")) for x in r.offending) for r in found)
    assert all(x in texts[r.doc_id] for r in found for x in r.offending)


def test_held_out_labels_are_not_read(spark):
    from pyspark.sql import functions as F

    docs, marks = corpus(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(docs, marks), fit(docs, flipped)
    assert np.array_equal(a.keys, b.keys) and np.allclose(a.weights, b.weights)


def test_sentences_by_hand():
    texts, stops = parted(pa.array(["A b. C! d\ne", "", "f.g", None, "..."]))
    assert isinstance(texts, Texts)
    assert sentences(texts, stops).tolist() == [0, 0, 1, 2, 3, 4, 5]


def test_awkward_rows(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame([(3, 1, None), (None, 1, 1), (4, 1, 0), (5, 0, 0)], LABELS)
    rows = toxicity(docs, marks).collect()
    assert len(rows) == docs.count() and all(0 <= r.score < 0.3 for r in rows)
    assert toxicity(empty(spark), marks).count() == 0
    assert toxicity(docs, marks.where("false")).where("score > 0.01").count() == 0


def test_scores_are_the_noisy_or_of_sentences(spark):
    """Scores worked out again, word by word, from the fitted weights."""
    import math
    import re

    from factloom.llm.toxicity import PREFIXES, features

    docs, marks = corpus(spark, 300)
    model = fit(docs, marks)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def keys(word):
        return [int(k) for _, own in features(parted(pa.array([word]))[0]) for k in own]

    assert len(keys("grobl")) == 1 + sum(len("grobl") > k for k in PREFIXES)
    got = {r.doc_id: r.score for r in toxicity(docs, marks).collect()}
    for r in docs.collect():
        none = 1.0
        for sentence in re.split(r"[.!?\n]", r.text):
            words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence)
            if words:
                none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights.get(k, 0.0) for w in words for k in keys(w.lower())))))
        assert abs(got[r.doc_id] - (1 - none)) < 1e-9


def test_accuracy_on_held_out_labels(spark):
    """Of labelled documents that the fit hasn't seen, toxic ones are found and others left alone."""
    from factloom.llm.toxicity import op5_toxicity_mil

    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = op5_toxicity_mil(spark, "/root/testdata/sf0.01").where("held_out").join(marks, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) > 10 and sum(toxic) / len(toxic) > 0.85
    assert len(clean) > 50 and sum(clean) / len(clean) < 0.03
