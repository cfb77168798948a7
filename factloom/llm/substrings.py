"""Substring dedup: compressed FM-indexes per shard, backward search, matching statistics.

A word is removed if a window of WINDOW words covers it whose word sequence also starts earlier
(smaller doc_id, or earlier in the document).

Shards. The least of the 14 seven-word hashes in a window is its anchor, so copies of a window have
copies of the anchor; windows of one document that choose the same anchor place are one segment. A
segment travels as numbers (anchor, digest, place): equal segments are settled by their least place
(within a task first, then across tasks), and only segments whose anchor also has different
segments need their words looked at. Those words go to the shard of the anchor. A shard builds an
FM-index over its segments in order of place and streams every segment's windows through backward
search: an interval of two or more rows that reaches WINDOW symbols and whose earliest place comes
before the window's own removes the window.

Hot anchors. An anchor with more than HOT different segments in a task, or HOT_ALL altogether, goes
by single windows from then on, sharded by the window's own digest, so the segments of a passage that a
third of all documents share spread over all shards; tasks send each window once.

Texts cross the network once to meet the verdicts; those that still wait for a shard's answer are
kept in a table of the shared folder and cross once more.

Defined results: null and empty texts have no words; fewer than WINDOW words are never removed; rows
that share a doc_id are one document, whose equal places aren't earlier than each other; null
doc_ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import Texts, gram_hashes, mix, saved, small_batches, table, texts_of
from .fmindex import FMIndex

WINDOW, GRAM = 20, 7
SPAN = WINDOW - GRAM + 1
HOT, HOT_ALL = 256, 4096
#: Segments a task gathers before it sends them on.
FLUSH = 1_000_000
#: Text of one bucket or shard; their number follows the data, and a task holds one at a time.
BUCKET_BYTES = 16 << 20
#: Order of a null doc_id.
LAST = (1 << 63) - 1

GONE, LOOK, SINGLE = 0, 1, 2
SEGMENTS = {"a": "<u8", "g": "<u8", "d": "<i8", "s": "<i4", "l": "<u1", "nd": "<i8", "ns": "<i4", "nl": "<u1", "nk": "<u1", "na": "<u8"}
NOTES = "d long, s binary, l binary, k binary, a binary"
FOUND = (
    "doc_id long, d long, n_words long, done boolean, n_removed long, kept_sha256 string, text string, gone binary, "
    "a binary, s binary, l binary"
)
WORDS = {"d": "<i8", "s": "<i4", "l": "<u1", "w": "<u8"}
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Runs:
    """Digests of any run of words of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(n, _P))
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = np.cumprod(np.full(n, _Q))
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = np.cumsum(h * powers[:n])

    def digest(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.back[at]) + np.asarray(length).astype(np.uint64)


def segments(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, anchor hash) of the runs of windows that choose one anchor place."""
    none = np.zeros(0, np.int64)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return none, none, none.astype(np.uint64)
    grams = gram_hashes(h, GRAM)
    low = grams[:n].copy()
    for i in range(1, SPAN):
        np.minimum(low, grams[i : n + i], out=low)
    anchor = np.zeros(n, np.int64)
    for i in range(SPAN - 1, -1, -1):
        np.copyto(anchor, np.arange(i, n + i), where=grams[i : n + i] == low)
    whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    if not len(whole):
        return none, none, none.astype(np.uint64)
    new = np.concatenate([[True], (np.diff(whole) != 1) | (anchor[whole][1:] != anchor[whole][:-1]) | (owner[whole][1:] != owner[whole][:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(whole)]]))
    return whole[first], count + WINDOW - 1, grams[anchor[whole[first]]]


def note_batch(d: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Notes of each document as packed arrays, one row per document."""
    kinds = {"s": "<i4", "l": "<u1", "k": "<u1", "a": "<u8"}
    order, begins = packed.grouped([d, columns["s"]]) if len(d) else (np.zeros(0, int), np.zeros(0, int))
    d = d[order]
    begins = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else begins
    stops = np.concatenate([begins[1:], [len(d)]]) if len(d) else begins
    arrays = [pa.array(d[begins], pa.int64())]
    for name, kind in kinds.items():
        own = columns[name][order].astype(kind)
        arrays.append(pa.array([own[a:b].tobytes() for a, b in zip(begins, stops, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["d", *kinds])


def settled(seg: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Segments by (anchor, digest, place), and which of them equal an earlier one (1) or repeat its very place (2)."""
    order, _ = packed.grouped([seg["a"], seg["g"], seg["d"], seg["s"]])
    seg = {k: v[order] for k, v in seg.items()}
    same = np.zeros(len(order), bool)
    same[1:] = (seg["a"][1:] == seg["a"][:-1]) & (seg["g"][1:] == seg["g"][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    at_first = (seg["d"] == seg["d"][first]) & (seg["s"] == seg["s"][first])
    return seg, np.where(same, np.where(at_first, 2, 1), 0)


def per_anchor(a: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """For sorted anchors, how many of the counted rows each row's anchor has."""
    new = np.concatenate([[True], a[1:] != a[:-1]])
    group = np.cumsum(new) - 1
    return np.bincount(group, weights=counted)[group]


def notes_of(seg: dict[str, np.ndarray], at: np.ndarray, kind: np.ndarray | int) -> dict[str, np.ndarray]:
    return {"nd": seg["d"][at], "ns": seg["s"][at], "nl": seg["l"][at], "nk": np.broadcast_to(np.uint8(kind), (len(at),)) if np.isscalar(kind) else kind, "na": seg["a"][at]}


def cut(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task's texts by bucket, equal ones settled first."""
    parts: list[dict[str, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        seg, repeat = settled({k: np.concatenate([p[k] for p in parts]) for k in ("a", "g", "d", "s", "l")})
        hot = per_anchor(seg["a"], repeat == 0) > HOT
        gone, single = np.flatnonzero(repeat == 1), np.flatnonzero((repeat == 0) & hot)
        for at, kind in ((gone, GONE), (single, SINGLE)):
            if len(at):
                yield packed.split((mix(seg["d"][at].astype(np.uint64)) % np.uint64(n)).astype(np.int64), notes_of(seg, at, kind), SEGMENTS)
        keep = np.flatnonzero((repeat == 0) & ~hot)
        told = single[np.concatenate([[True], seg["a"][single][1:] != seg["a"][single][:-1]])] if len(single) else single
        out = {k: np.concatenate([v[keep], v[told]]) for k, v in seg.items()}
        out["l"][len(keep) :] = 0  # tells the bucket that the anchor is hot
        yield packed.split((out["a"] % np.uint64(n)).astype(np.int64), out, SEGMENTS)

    for batch in batches:
        texts = Texts(batch.column(1))
        h, owner = texts.hashes(), texts.owner()
        begin, length, anchor = segments(h, owner)
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        doc = owner[begin]
        parts.append({"a": anchor, "g": Runs(h).digest(begin, length), "d": ids[doc], "s": (begin - texts.first[doc]).astype(np.int32), "l": length.astype(np.uint8)})
        size += len(begin)
        if size > FLUSH:
            yield from flush()
            parts, size = [], 0
    if size:
        yield from flush()


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in packed.by_bucket(batches, SEGMENTS):
        yield judged(got)


def judged(got: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A bucket's segments: which are gone, which must be looked at and how."""
    seg, repeat = settled({k: got[k] for k in ("a", "g", "d", "s", "l")})
    told = seg["l"] == 0
    told_any = per_anchor(seg["a"], told) > 0 if len(told) else told
    # a hot anchor's own notice isn't a segment: settle the rest again without it
    if told.any():
        seg2, repeat2 = settled({k: v[~told] for k, v in seg.items()})
        told_any = np.isin(seg2["a"], np.unique(seg["a"][told]))
        seg, repeat = seg2, repeat2
    different = per_anchor(seg["a"], repeat == 0) if len(repeat) else np.zeros(0)
    single = told_any | (different > HOT_ALL)
    at = np.flatnonzero((repeat == 1) | ((repeat == 0) & (single | (different > 1))))
    kind = np.where(repeat[at] == 1, GONE, np.where(single[at], SINGLE, LOOK)).astype(np.uint8)
    own = notes_of(seg, at, kind)
    both = {k: np.concatenate([own[k], got[k]]) for k in ("nd", "ns", "nl", "nk", "na")}
    return note_batch(both["nd"], {"s": both["ns"], "l": both["nl"], "k": both["nk"], "a": both["na"]})


def covered(n: int, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.bincount(begins, minlength=n + 1) - np.bincount(begins + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def kept_words(text: bytes, gone: np.ndarray | None) -> bytes:
    words = text.split()
    return b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def unpacked(notes: list[dict], name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(n[name] for n in notes), kind)


def looked(batches: Iterator[pa.RecordBatch], texts_too: bool) -> Iterator[pa.RecordBatch]:
    """Apply what is settled; hand on the words of what a shard must look at."""
    for batch in batches:
        texts = Texts(batch.column(2))
        h = texts.hashes()
        runs = Runs(h)
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        raw = batch.column(2).cast(pa.large_binary()).to_pylist()
        gone: list[np.ndarray | None] = []
        look: list[list[np.ndarray]] = []
        singles: list[np.ndarray] = []
        for i, notes in enumerate(batch.column(3).to_pylist()):
            n, at = int(texts.first[i + 1] - texts.first[i]), int(texts.first[i])
            if not notes:
                gone.append(None)
                look.append([])
                continue
            s, length, kind, a = (unpacked(notes, c, t) for c, t in (("s", "<i4"), ("l", "<u1"), ("k", "<u1"), ("a", "<u8")))
            s, length = s.astype(np.int64), length.astype(np.int64)
            fits = s + length <= n  # rows that share a doc_id may differ in length
            s, length, kind, a = s[fits], length[fits], kind[fits], a[fits]
            own = kind == GONE
            gone.append(covered(n, s[own], length[own]))
            own = kind == LOOK
            look.append([a[own], s[own], length[own]])
            own = np.flatnonzero(kind == SINGLE)
            if len(own):
                starts = np.concatenate([np.arange(s[j], s[j] + length[j] - WINDOW + 1) for j in own])
                singles.append(np.stack([np.full(len(starts), i), starts]))
        if singles:  # single windows: each once a batch, at its least place
            doc, s = np.concatenate(singles, axis=1)
            digest = runs.digest(texts.first[doc] + s, WINDOW)
            key = np.array([LAST if k is None else k for k in keys], np.int64)[doc]
            order, _ = packed.grouped([digest, key, s])
            doc, s, digest, key = doc[order], s[order], digest[order], key[order]
            same = np.concatenate([[False], digest[1:] == digest[:-1]])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            again = same & ((key != key[first]) | (s != s[first]))
            for i in np.unique(doc).tolist():
                own = (doc == i) & again
                gone[i] |= covered(len(gone[i]), s[own], np.full(int(own.sum()), WINDOW))
                own = (doc == i) & ~again
                look[i] = [np.concatenate(x) for x in zip(look[i], [mix(digest[own]), s[own], np.full(int(own.sum()), WINDOW)], strict=True)]
        rows = []
        for i, (doc_id, key, text) in enumerate(zip(ids, keys, raw, strict=True)):
            n = int(texts.first[i + 1] - texts.first[i])
            if look[i] and len(look[i][0]):
                a, s, length = look[i]
                rows.append((doc_id, key, n, False, None, None, text.decode(), np.packbits(gone[i]).tobytes(), a.astype("<u8").tobytes(), s.astype("<i4").tobytes(), length.astype("<u1").tobytes()))
            else:
                kept = kept_words(text or b"", gone[i])
                removed = 0 if gone[i] is None else int(gone[i].sum())
                rows.append((doc_id, key, n, True, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if texts_too else None, None, None, None, None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def to_shards(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Segments with their words, by shard; rows of a batch are packed together."""
    for batch in batches:
        parts: dict[int, dict[str, list[bytes]]] = {}
        texts = Texts(batch.column(1))
        h = texts.hashes()
        for first, d, a, s, length in zip(texts.first.tolist(), *(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=False):
            shard = (np.frombuffer(a, "<u8") % np.uint64(n)).astype(np.int64)
            s, length = np.frombuffer(s, "<i4"), np.frombuffer(length, "<u1")
            for j, b in enumerate(shard.tolist()):
                own = parts.setdefault(b, {k: [] for k in WORDS})
                own["d"].append(int(d).to_bytes(8, "little", signed=True))
                own["s"].append(s[j : j + 1].tobytes())
                own["l"].append(length[j : j + 1].tobytes())
                own["w"].append(h[first + s[j] : first + s[j] + length[j]].tobytes())
        if parts:
            arrays = [pa.array(list(parts), pa.int32()), *(pa.array([b"".join(p[k]) for p in parts.values()], pa.binary()) for k in WORDS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", *WORDS])


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in packed.by_bucket(batches, WORDS):
        if len(got["d"]):
            yield answered(got)


def answered(got: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A shard: index its segments, stream their windows through it, note those that start earlier elsewhere."""
    order = np.lexsort([got["s"], got["d"]])
    lengths = got["l"].astype(np.int64)
    begins = (np.cumsum(lengths) - lengths)[order]
    d, s, lengths = got["d"][order], got["s"][order].astype(np.int64), lengths[order]
    symbols = np.unique(got["w"], return_inverse=True)[1] + 1
    at = np.cumsum(lengths + 1) - (lengths + 1)  # where each segment begins in the text; 0 parts them
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[np.repeat(at, lengths) + inner] = symbols[np.repeat(begins, lengths) + inner]
    index = FMIndex(text, WINDOW)
    windows = lengths - WINDOW + 1
    seg = np.repeat(np.arange(len(d)), windows)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = at[seg] + offset + WINDOW
    length, low, high = index.statistics(ends, text, WINDOW, least=2)
    hit = np.flatnonzero(length == WINDOW)
    place = index.first(low[hit], high[hit])
    source = np.searchsorted(at, place, "right") - 1
    own_d, own_s = d[seg[hit]], s[seg[hit]] + offset[hit]
    from_d, from_s = d[source], s[source] + place - at[source]
    earlier = (from_d < own_d) | ((from_d == own_d) & (from_s < own_s))
    own_d, own_s = own_d[earlier], own_s[earlier]
    zero = np.zeros(len(own_d))
    return note_batch(own_d, {"s": own_s, "l": zero + WINDOW, "k": zero, "a": zero})


def finished(batches: Iterator[pa.RecordBatch], texts_too: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, text, bits, notes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            gone = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            if notes:
                s = unpacked(notes, "s", "<i4").astype(np.int64)
                s = s[s + WINDOW <= n]
                gone |= covered(n, s, np.full(len(s), WINDOW))
            kept = kept_words(text.encode(), gone)
            rows.append((doc_id, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts_too else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def by_document(notes: DataFrame) -> DataFrame:
    return notes.groupBy("d").agg(F.collect_list(F.struct("s", "l", "k", "a")).alias("notes"))


def substring_dedup(docs: DataFrame, texts_too: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with texts_too) kept of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = texts_of(docs)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(packed.partitions(spark), int(total / BUCKET_BYTES))
    notes = packed.dealt(texts.mapInArrow(lambda it: cut(it, n), packed.schema(SEGMENTS))).sortWithinPartitions("bucket").mapInArrow(met, NOTES)
    keyed = texts.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), "text")
    joined = keyed.join(by_document(notes), "d", "left").select("doc_id", "d", "text", "notes")
    found = saved(joined.mapInArrow(lambda it: looked(it, texts_too), FOUND), "substrings")
    waiting = found.where("not done")
    shards = packed.dealt(waiting.select("d", "text", "a", "s", "l").mapInArrow(lambda it: to_shards(it, n), packed.schema(WORDS))).sortWithinPartitions("bucket")
    answers = shards.mapInArrow(searched, NOTES)
    rest = waiting.select("doc_id", "d", "n_words", "text", "gone").join(by_document(answers), "d", "left")
    rest = rest.select("doc_id", "n_words", "text", "gone", "notes").mapInArrow(lambda it: finished(it, texts_too), RESULT)
    return found.where("done").select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("text").alias("kept")).union(rest)


def op7_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts_too=False).drop("kept")


OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) i, w from d where len(w) >= 20),
g as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) > 1 later from s),
p as (select distinct doc_id, unnest(range(i, i + 20)) k from g where later),
r as (select doc_id, list(k) gone from p group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) kept_sha256
from d left join r using (doc_id)
"""
