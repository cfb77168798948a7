"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed n-grams of NGRAM bytes are counted: one over every document (raw), one
over the documents that `labels` marks as trusted (quality = 1). A document's score is the mean over
its n-grams of log p_target - log p_raw; it is kept when the score reaches `threshold` and the
base rules hold. The verdict depends on the tables alone: no sampling, no randomness, and the ratios are
integers (units of 1 / UNIT), so that sums don't depend on the order or on which rows share a batch.

Defined results: a null text has no words; a document shorter than an n-gram scores 0; one
without words fails the base rules; repeated rows are counted and judged like any other row; an empty table gives no rows.
Null doc_ids are kept and never count as trusted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, gram_hashes, map_texts, mask_of, mix, small_batches, table, texts_of

NGRAM, BITS = 3, 14
BUCKETS = 1 << BITS
#: About midway between what good and bad documents score that the fit hasn't seen and the base rules keep: on held-out labels (the quarter
#: that op5 holds out) good ones score -0.28 or more, bad ones -1.19 or less at sf0.01, -0.04 and -1.42 at sf0.1.
THRESHOLD = -0.7
SYMBOLS = mask_of(b"#*$%&|<>")
CONTINUATION = mask_of(bytes(range(0x80, 0xC0)))
MIN_WORDS = 50
#: Log ratios are held as integers, in this part of one.
UNIT = 1 << 24

COUNTS = "counts array<bigint>"
#: Tasks that sum what the counting tasks found.
SUM_TASKS = 8
SCORES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def gram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every byte of the batch, and the range of those inside each text."""
    data = texts.data.astype(np.uint32)
    n = max(0, len(data) - NGRAM + 1)
    key = np.zeros(n, np.uint32)
    for i in range(NGRAM):
        key = (key << np.uint32(8)) | data[i : n + i]
    begins = np.minimum(texts.offsets[:-1], n)
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BITS), begins, np.maximum(begins, texts.offsets[1:] - NGRAM + 1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row, the n-gram counts of its texts."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        buckets, begins, ends = gram_buckets(Texts(batch.column(1)))
        edges = np.bincount(begins, minlength=len(buckets) + 1) - np.bincount(ends, minlength=len(buckets) + 1)
        total += np.bincount(buckets[np.cumsum(edges[:-1]) > 0], minlength=BUCKETS)
    yield as_row(total)


def as_row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), pa.array(total))], names=["counts"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += batch.column(0).flatten().to_numpy().reshape(-1, BUCKETS).sum(axis=0)
    yield as_row(total)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the values that occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeat_words(texts: Texts, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per text, its words inside three-word windows found twice or more in that text."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        inner = owner[2:] == owner[:-2]
        again = np.zeros(len(inner), bool)
        again[inner] = repeated(gram_hashes(hashes, 3)[inner] ^ mix(owner[2:][inner].astype(np.uint64)))
        for i in range(3):
            covered[i : len(again) + i] |= again
    return np.bincount(owner[covered], minlength=len(texts))


def dup_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())


def base_rules(column: pa.Array, texts: Texts) -> dict[str, np.ndarray]:
    hashes, owner, n = texts.hashes(), texts.owner(), np.diff(texts.first)
    repeats = repeat_words(texts, hashes, owner)
    return {
        "n_words": n,
        "word_chars": texts.sums(texts.inside & ~CONTINUATION[texts.data]),
        "n_symbols": texts.sums(SYMBOLS[texts.data]),
        "n_dup_lines": np.array([dup_lines(x or b"") for x in column.cast(pa.large_binary()).to_pylist()], np.int64),
        "n_repeat_words": repeats,
        "base_failed": (n < MIN_WORDS) | (100 * repeats > 50 * n),
    }


def scored(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch.column(1))
        buckets, begins, ends = gram_buckets(texts)
        total = np.concatenate([[0], np.cumsum(ratio[buckets])])
        score = (total[ends] - total[begins]) / (np.maximum(ends - begins, 1) * UNIT)
        out = base_rules(batch.column(1), texts)
        out |= {"score": score, "kept": ~out["base_failed"] & (score >= threshold)}
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], names=["doc_id", *out])


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts that labels marks as trusted, all of them; one merge join at every size."""
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return texts_of(docs).join(ids.hint("merge"), "doc_id", "left_semi")


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts, and once more."""
    parts = texts.mapInArrow(counted, COUNTS).repartition(SUM_TASKS).mapInArrow(summed, COUNTS)
    return sum((np.array(r.counts) for r in parts.collect()), np.ones(BUCKETS))


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of every bucket, each smoothed by one count a bucket; in integers of 1 / UNIT."""
    target = bucket_counts(trusted(docs, labels))
    if target.sum() == BUCKETS:  # nothing is trusted: no evidence against any text
        return np.zeros(BUCKETS, np.int64)
    raw = bucket_counts(texts_of(docs))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return np.rint(ratio * UNIT).astype(np.int64)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep_rows: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row of docs (keep_rows: and its text and rest)."""
    spark = docs.sparkSession
    small_batches(spark)
    ratio = spark.sparkContext.broadcast(log_ratio(docs, labels))
    return map_texts(docs, lambda it: scored(it, ratio.value, threshold), SCORES, keep_rows)


def op8_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
