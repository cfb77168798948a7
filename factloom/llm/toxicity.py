"""Toxicity by multiple-instance learning: only documents carry labels, sentences are scored.

A sentence scores the logistic of a bias and the weights of its words' features (the word, and its
beginnings of 4, 5 and 6 bytes, which inflected insults share). A document's score is the noisy-or
of its sentences: 1 - prod(1 - p). Weights are fitted by gradient ascent on the document labels
alone; afterwards the sentence scores locate what offends.

Fit: on at most MAX_DOCS labelled rows outside the held-out quarter (first by hash of the id), whole
texts. Candidate features are those clearly likelier in toxic documents, counted and chosen on
executors; they alone, and where they occur in those rows, reach the driver, which ascends the
likelihood. Scoring runs over every whole text.

Defined results: null and empty texts score 0; unlabelled and null-labelled rows don't take part in
the fit; without a labelled toxic row every score is 0; a null doc_id isn't held out; rows that
share a doc_id are scored one by one and share a label; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import Texts, _table, mask_of, mix, small_batches, table, texts_of
from .decontaminate import BREAK, FOLD

#: Labelled rows that fit the model.
MAX_DOCS = 20_000
#: A candidate feature occurs in so many toxic documents, and so many times likelier there.
MIN_DOCS, MIN_LIFT = 3, 4.0
PREFIXES = (4, 5, 6)
ROUNDS, RATE, DECAY = 400, 0.1, 0.002
THRESHOLD = 0.3

STOP = mask_of(b".!?\n")
SCORES = "doc_id long, score double, offending array<string>"


class Model:
    """Weights by feature hash (sorted), and the bias of a sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(keys >> np.uint64(48)).astype(np.int64)] = True

    def slots(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which features the model knows, and their slots."""
        some = np.flatnonzero(self.likely[(features >> np.uint64(48)).astype(np.int64)])
        if not len(self.keys):
            return some, some
        slot = np.minimum(np.searchsorted(self.keys, features[some]), len(self.keys) - 1)
        known = self.keys[slot] == features[some]
        return some[known], slot[known]


def features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, feature of each) for each kind of feature."""
    lengths = texts.ends - texts.starts
    yield np.arange(len(lengths)), texts.hashes()
    codes = _table(11, 256)
    for k in PREFIXES:
        own = np.flatnonzero(lengths > k)
        h = np.full(len(own), np.uint64(k))
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + codes[texts.data[texts.starts[own] + i]]
        yield own, mix(h)


def sentences(texts: Texts, stops: np.ndarray) -> np.ndarray:
    """For each word, the number of its sentence within the batch."""
    if not len(texts.starts):
        return np.zeros(0, np.int64)
    before = np.cumsum(stops)[texts.starts]
    owner = texts.owner()
    return np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (owner[1:] != owner[:-1]))])


def parted(column: pa.Array) -> tuple[Texts, np.ndarray]:
    raw = Texts(column)
    return Texts(column, BREAK, FOLD), STOP[raw.data]


#: What the counting tasks send: feature, in how many toxic documents, in how many others.
COUNTS = {"key": "<u8", "bad": "<i8", "good": "<i8"}


def summed_up(keys: list[np.ndarray], bad: list[np.ndarray], good: list[np.ndarray]) -> dict[str, np.ndarray]:
    own, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = lambda x: np.bincount(back, weights=np.concatenate(x), minlength=len(own)).astype(np.int64)
    return {"key": own, "bad": total(bad), "good": total(good)}


def counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Features by bucket, with how many toxic and other documents of the batch hold them."""
    for batch in batches:
        texts, _ = parted(batch.column(1))
        label, owner = batch.column(2).to_numpy(zero_copy_only=False) > 0, texts.owner()
        keys, toxic = [], []
        for words, own in features(texts):
            pairs = np.unique(np.stack([own, owner[words].astype(np.uint64)], axis=1), axis=0)
            keys.append(pairs[:, 0])
            toxic.append(label[pairs[:, 1].astype(np.int64)])
        out = summed_up(keys, toxic, [~x for x in toxic])
        yield packed.split((out["key"] % np.uint64(n)).astype(np.int64), out, COUNTS)


def candidates(batches: Iterator[pa.RecordBatch], toxic: int, others: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the features clearly likelier in toxic documents, with their lift."""
    for got in packed.by_bucket(batches, COUNTS):
        own = summed_up([got["key"]], [got["bad"]], [got["good"]])
        lift = (own["bad"] / max(1, toxic)) / ((own["good"] + 0.5) / max(1, others))
        keep = (own["bad"] >= MIN_DOCS) & (lift >= MIN_LIFT)
        yield pa.RecordBatch.from_arrays([pa.array(own["key"][keep].view(np.int64)), pa.array(lift[keep])], names=["key", "lift"])


def bags(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document: its label, its number of sentences, and (sentence, slot) of known features."""
    model = Model(keys, np.zeros(len(keys)), 0.0)
    for batch in batches:
        texts, stops = parted(batch.column(1))
        number, owner = sentences(texts, stops), texts.owner()
        found = [(own[at], slot) for own, feature in features(texts) for at, slot in [model.slots(feature)]]
        word, slot = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(word, kind="stable")
        word, slot = word[order], slot[order]
        cuts = np.searchsorted(owner[word], np.arange(len(texts) + 1))
        rows = []
        for i, label in enumerate(batch.column(2).to_pylist()):
            own = slice(cuts[i], cuts[i + 1])
            at, to = texts.first[i], texts.first[i + 1]
            n = int(number[to - 1] - number[at] + 1) if to > at else 0
            rows.append((label, n, (number[word[own]] - (number[at] if n else 0)).astype("<i4").tobytes(), slot[own].astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
            names=["toxic", "n", "sentence", "slot"],
        )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.minimum(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 - 1e-12)


def fitted(keys: np.ndarray, start: np.ndarray, toxic: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence: np.ndarray, slot: np.ndarray) -> Model:
    """Noisy-or likelihood of the labels, ascended by Adam. One entry of doc, sentence and slot a feature."""
    where = doc.astype(np.int64) << 32 | sentence
    bag, row = np.unique(where, return_inverse=True)
    bag_doc = bag >> 32
    bare = n - np.bincount(bag_doc, minlength=len(n))  # sentences without a known feature
    x = np.concatenate([start, [-8.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, ROUNDS + 1):
        p = sigmoid(np.bincount(row, weights=x[slot], minlength=len(bag)) + x[-1])
        p0 = sigmoid(x[-1:])[0]
        none = np.bincount(bag_doc, weights=np.log1p(-p), minlength=len(n)) + bare * np.log1p(-p0)
        some = np.maximum(-np.expm1(none), 1e-12)
        pull = np.where(toxic > 0, np.exp(none) / some, -1.0)  # d log-likelihood / d logit is pull * p
        at_bag = pull[bag_doc] * p
        grad = np.append(np.bincount(slot, weights=at_bag[row], minlength=len(keys)), at_bag.sum() + (pull * bare).sum() * p0) / max(1, len(n))
        grad[:-1] -= DECAY * x[:-1] / max(1, len(keys)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(keys, x[:-1], float(x[-1]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # a bounded side
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    counts = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n = packed.partitions(docs.sparkSession)
    dealt = packed.dealt(rows.mapInArrow(lambda it: counted(it, n), packed.schema(COUNTS))).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(lambda it: candidates(it, counts.get(1, 0), counts.get(0, 0)), "key long, lift double").toArrow()
    key, lift = found["key"].to_numpy().view(np.uint64), found["lift"].to_numpy()
    if not len(key):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    order = np.argsort(key)
    key, lift = key[order], lift[order]
    shared = docs.sparkSession.sparkContext.broadcast(key)
    found = rows.mapInArrow(lambda it: bags(it, shared.value), "toxic int, n int, sentence binary, slot binary").collect()
    sizes = [len(r.slot) // 4 for r in found]
    return fitted(
        key, np.log(lift) / 2, np.array([r.toxic for r in found]), np.array([r.n for r in found]), np.repeat(np.arange(len(found)), sizes),
        np.concatenate([np.frombuffer(r.sentence, "<i4") for r in found]).astype(np.int64), np.concatenate([np.frombuffer(r.slot, "<i4") for r in found]),
    )


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, stops = parted(batch.column(1))
        number, owner = sentences(texts, stops), texts.owner()
        total = np.zeros(int(number[-1]) + 1 if len(number) else 0)
        for own, feature in features(texts):
            at, slot = model.slots(feature)
            total += np.bincount(number[own[at]], weights=model.weights[slot], minlength=len(total))
        p = sigmoid(total + model.bias)
        begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        score = -np.expm1(np.bincount(owner[begin], weights=np.log1p(-p), minlength=len(texts)))
        offending: list[list[str]] = [[] for _ in range(len(texts))]
        raw = Texts(batch.column(1)).data
        for s in np.flatnonzero(p >= THRESHOLD).tolist():
            last = (begin[s + 1] if s + 1 < len(begin) else len(number)) - 1
            offending[owner[begin[s]]].append(raw[texts.starts[begin[s]] : texts.ends[last]].tobytes().decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0.0, 1.0)), pa.array(offending, pa.list_(pa.string()))], names=["doc_id", "score", "offending"])


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, max_docs))
    out = texts_of(docs).mapInArrow(lambda it: scored(it, model.value), SCORES)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")
