"""Benchmark decontamination by winnowing.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. Of every six
consecutive five-word hashes the least is kept as a fingerprint, on both sides, with the five words
before it and the ten from it on. Both sides' fingerprints are tables that Spark joins; each meeting
is extended word by word in both directions and counts where ten words or more are equal. A shared
window of ten words holds six five-word hashes, so its least one is kept on both sides, and the
words carried along reach over the window: every shared window is found, whole texts never meet.
Items of fewer than ten words are one window, met by the hash of all their words.

Before the join, documents' fingerprints pass a bitmap of the items' ones: 2 MB whatever the size of
the benchmark (a full one lets everything through, and the join decides).

Defined results: null or empty texts have no words and no hits; rows with equal doc_ids are judged
one by one (equal rows alike); items that share an id count once, and so do those without
one, which hit like any other and are left out of the list of ids; empty items never occur; an empty benchmark hits
nothing; very long texts travel through the join as fingerprints alone; other columns of either table,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, carried, gram_hashes, lowest, mix, saved, small_batches, table

WINDOW, GRAM = 10, 5
#: Bits of the bitmap of fingerprints, as a power of two.
BITS = 24

#: What parts words, and A-Z to a-z.
BREAK = np.zeros(256, bool)
BREAK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

#: A fingerprint: its hash, how many words must be equal, where it stands, the words before it (nearest first) and from it on.
PRINT = "struct<fp:bigint,need:int,at:int,before:array<string>,after:array<string>>"
PRINT_TYPE = pa.struct([("fp", pa.int64()), ("need", pa.int32()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def whole_print(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words that make up an item."""
    return gram_hashes(hashes, k) ^ mix(np.array([k], np.uint64))


def prints(texts: Texts, places: np.ndarray, fps: np.ndarray, size: int, need: int) -> list[list[dict]]:
    """By text, the fingerprints of `size` words at these places, those left out that run over the end of their text."""
    doc = np.searchsorted(texts.first, places, "right") - 1
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    back, ahead = (WINDOW - GRAM, WINDOW) if need == WINDOW else (0, size)
    for at, fp, i in zip(places.tolist(), fps.astype(np.int64).tolist(), doc.tolist(), strict=True):
        begin, end = int(texts.first[i]), int(texts.first[i + 1])
        if at + size <= end:
            before, after = texts.words(max(begin, at - back), at)[::-1], texts.words(at, min(end, at + ahead))
            out[i].append({"fp": fp, "need": need, "at": at - begin, "before": [w.decode() for w in before], "after": [w.decode() for w in after]})
    return out


def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item with its fingerprints."""
    for batch in batches:
        texts = Texts(batch.column(1), BREAK, FOLD)
        hashes, n = texts.hashes(), np.diff(texts.first)
        grams = gram_hashes(hashes, GRAM)
        kept = np.flatnonzero(lowest(grams, WINDOW - GRAM + 1))
        long = n[np.searchsorted(texts.first, kept, "right") - 1] >= WINDOW
        out = prints(texts, kept[long], grams[kept[long]], GRAM, WINDOW)
        for k in range(1, WINDOW):
            at = texts.first[:-1][n == k]
            for i, own in enumerate(prints(texts, at, whole_print(hashes, k)[at] if len(at) else np.zeros(0, np.uint64), k, k)):
                out[i] += own
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(PRINT_TYPE))], names=["item_id", "prints"])


def document_prints(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, short: list[int]) -> Iterator[pa.RecordBatch]:
    """One row per document: its number of words, and those of its fingerprints that the bitmap knows."""
    for batch in batches:
        texts = Texts(batch.column(1), BREAK, FOLD)
        hashes = texts.hashes()
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for k in (WINDOW, *short):
            fps = gram_hashes(hashes, GRAM) if k == WINDOW else whole_print(hashes, k)
            known = bitmap[(fps >> np.uint64(65 - len(bitmap).bit_length())).astype(np.int64)]
            if k == WINDOW and known.any():
                known &= lowest(fps, WINDOW - GRAM + 1)
            at = np.flatnonzero(known)
            if len(at):
                for i, own in enumerate(prints(texts, at, fps[at], GRAM if k == WINDOW else k, k)):
                    out[i] += own
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.diff(texts.first)), pa.array(out, pa.list_(PRINT_TYPE))], names=["doc_id", "key", "n_words", "prints"]
        )


def bitmap_of(prints: DataFrame) -> np.ndarray:
    """Which leading bits of fingerprints occur, summed up on executors."""
    slot = F.shiftrightunsigned("fp", 64 - BITS) + 1
    parts = prints.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << BITS, bool)
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part.bits, np.uint8), bitorder="little").astype(bool)
        out[(part.bucket - 1) * len(bits) : part.bucket * len(bits)] = bits
    return out


def equal_words(a: str, b: str) -> Column:
    """How many words two lists have in common before they first differ."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each hit document: how many words its hits cover, the covered spans, and its items."""
    for batch in batches:
        rows = []
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for at, to in sorted((s["at"], s["to"]) for s in spans):
                if merged and at <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], to)
                else:
                    merged.append([at, to])
            met = {i["id"] for i in items}
            names = sorted(i for i in met if i is not None)
            rows.append((sum(b - a for a, b in merged), len(met), [{"at": a, "to": b} for a, b in merged], names))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())])), pa.list_(pa.string()))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["of", "of_key", "n_hit", "n_items", "spans", "items"])


def hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The hit documents: of, of_key, n_hit, n_items, spans, items. Both sides are rows of one fingerprint."""
    named = items.groupBy("fp", "need", F.col("before").alias("item_before"), F.col("after").alias("item_after")).agg(F.collect_set(F.struct(F.col("item_id").alias("id"))).alias("items"))
    met = documents.join(named, ["fp", "need"])
    left, right = equal_words("before", "item_before"), equal_words("after", "item_after")
    runs = met.select("doc_id", "key", "items", (F.col("at") - left).alias("at"), (F.col("at") + right).alias("to"), "need").where("to - at >= need")
    each = runs.select("doc_id", "key", "at", "to", F.explode("items").alias("item"))
    spans = each.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "to")).alias("spans"), F.collect_set("item").alias("items"))
    return spans.mapInArrow(summed, "of long, of_key long, n_hit long, n_items long, spans array<struct<at:int,to:int>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row per row of docs: its counts, the word spans hit and the items met (keep_rows: and its text and rest)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = saved(rows.mapInArrow(item_prints, f"item_id string, prints array<{PRINT}>").select("item_id", F.explode("prints").alias("p")).select("item_id", "p.*").drop("at"), "item-prints")
    bitmap = spark.sparkContext.broadcast(bitmap_of(items))
    short = sorted(r.need for r in items.where(F.col("need") < WINDOW).select("need").distinct().collect())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    scanned = own.mapInArrow(lambda it: document_prints(it, bitmap.value, short), f"doc_id long, key long, n_words long, prints array<{PRINT}>")
    scanned = saved(scanned, "prints")
    found = hits(scanned.select("doc_id", "key", F.explode("prints").alias("p")).select("doc_id", "key", "p.*"), items)
    if keep_rows:
        counts = scanned.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key"), "n_words").dropDuplicates(["c_id", "c_key"])
        base = carried(docs).withColumn("key", F.xxhash64("text"))
        base = base.join(counts, (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
        more = ["text", "rest"]
    else:
        base, more = scanned.select("doc_id", "key", "n_words"), []
    out = base.join(found, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<at:int,to:int>>")).alias("spans"), ids.alias("items"), *more,
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
with pattern as (select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' u, 'abcdefghijklmnopqrstuvwxyz' l),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) w from documents, pattern),
b as (select item_id::varchar item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) w from benchmark, pattern),
bs as (select item_id, w, least(10, len(w)) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') g from bs),
ns as (select distinct n from bw),
ds as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, ns where len(w) >= n),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') g from ds),
hit as (select doc_id, item_id, s, dw.n from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id collate "C") ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
""".replace(' collate "C"', "")
