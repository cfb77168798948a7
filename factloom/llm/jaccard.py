"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct word n-grams as 64-bit hashes; the order of those hashes is the global
order of n-grams, and cutting it at fixed places gives fragments. Two sets link when
DEN * |intersection| >= NUM * |union|.

Candidates. Sets that link differ in at most D = (1-t)/(1+t) of their sizes' sum, t = NUM/DEN, and
each n-gram in which they differ spoils one fragment at most. So of n fragments at least n - D are
the same on both sides. Each set drops the fragments of fewest n-grams (a rank by content alone, so
both sides rank a common fragment alike) until D + NEEDED are left, and sends their digests, dealt
by digest; a pair that links then shares at least NEEDED of them. Equal fragments are counted per
pair in each bucket for itself, and the partial counts are summed per pair by a shuffle. This is
done for the size classes that a set's partners may be in. A set with more empty fragments than it
may drop also sends the front of its n-grams in the global order, of which equally sparse partners
must share as many as it is longer than one shared n-gram asks for.

Pairs are counted only within groups of up to PAIRED sets of equal digests. Of larger groups a set
may hold SPARE = NEEDED // 2: its partners share at least NEEDED - SPARE digests in small groups all
the same, which is what the sums are held against. Sets that hold more are hot: hot sets in one large
group are tied to one of them (a star, never pairs). So a passage that many documents share ties
nothing unless it makes up much of them, and no pair is lost.

Verification. Tied sets form clusters, found as connected components. In a cluster of one block the
n-grams are cut along the global order into fragments of FRAGMENT, each fragment's partial overlaps
are counted for itself, as one matrix product, and summed per pair. A larger cluster is cut into
blocks of BLOCK_SETS sets or BLOCK_GRAMS n-grams; each block is counted with itself and with a few
pivots of the cluster, and only sets that this leaves outside the cluster's largest group go on to
meet all blocks. So a template with a million variants costs a million set transfers, not their
square. What links is sent on as a spanning forest, so no group's pairs are ever written out. Equal
sets are one class throughout.

Defined results: null or empty texts have an empty set and link with nothing; a text with fewer
words than n has its whole word sequence as its only n-gram; rows that share a doc_id are one
document as to links; null doc_ids link with nothing and have no component; an empty table gives
no rows; other columns, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packed
from .common import Texts, gram_hashes, mix, saved, small_batches, table, texts_of
from .graph import components

BLOCK_SETS, BLOCK_GRAMS = 1024, 2_000_000
#: N-grams of the global order that one matrix product covers.
FRAGMENT = 1024
#: Largest group of equal digests whose pairs are counted.
PAIRED = 8
#: Number of size classes; numbers from CLASSES on are those of prefix digests.
CLASSES = 64
#: Sets of a large cluster that all its blocks are held against first.
PIVOTS = 4
#: Digests a task gathers before it sends them on, pairs it gathers before it sums them, and digests meant for one bucket.
FLUSH, PAIRS, BUCKET = 1_000_000, 500_000, 700_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: What goes to a bucket: digests with their documents and marks (1: large group, 2: hot document); ties; members of groups known to be large.
SIGNS = {"sign": "<u8", "doc": "<i8", "mark": "<u1", "a": "<i8", "b": "<i8", "member": "<i8", "of": "<u8"}
#: Kinds of what a bucket finds.
PAIR, TIE, MEMBER = 0, 1, 2


class Join:
    """Shingle size, threshold num/den, and the size classes that follow from them."""

    def __init__(self, words: int = 3, num: int = 90, den: int = 100):
        self.words, self.num, self.den = words, num, den
        ratio = 1 + 3 * (1 - num / den)
        self.begins = [1]
        while len(self.begins) < CLASSES:
            self.begins.append(max(self.begins[-1] + 1, int(self.begins[-1] * ratio)))
        self.starts = np.array(self.begins)

    def apart(self, sizes: np.ndarray | int, others: np.ndarray | int) -> np.ndarray | int:
        """In how many n-grams linked sets of these sizes differ at most."""
        return (self.den - self.num) * (sizes + others) // (self.den + self.num)

    def largest(self, cls: int) -> int:
        return self.begins[cls + 1] - 1 if cls + 1 < CLASSES else self.begins[cls] * 4

    def needed(self, cls: int) -> int:
        """How many digests of a class a linked pair surely shares."""
        return max(1, self.apart(self.largest(cls), self.largest(cls)) // 4) if cls < CLASSES else self.drawn_out(cls - CLASSES)

    def spare(self, cls: int) -> int:
        """How many digests of large groups a set may hold without being hot."""
        return self.needed(cls) // 2

    def fragments(self, cls: int) -> int:
        apart = self.apart(self.largest(cls), self.largest(cls))
        sent = apart + self.needed(cls)
        return sent + sent // 10 + (2 if apart else 0)

    def drawn_out(self, cls: int) -> int:
        """How many n-grams of their prefixes linked sparse sets of a class surely share."""
        return max(1, self.begins[cls] // 8)

    def sets(self, texts: Texts) -> list[np.ndarray]:
        """The sorted distinct n-grams of each text."""
        h, n = texts.hashes(), self.words
        grams = gram_hashes(h, n)
        out = []
        for a, b in zip(texts.first[:-1].tolist(), texts.first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            else:
                out.append(gram_hashes(h[a:b], b - a, seed=b - a) if b > a else h[:0])
        return out

    def signs(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What the sets send and which set sends it: digests of fragments by class, prefixes of sparse sets; the class
        is in the lowest 7 bits."""
        sizes = np.array([len(s) for s in sets], np.int64)
        least = np.searchsorted(self.starts, sizes, "right") - 1
        most = np.searchsorted(self.starts, sizes * self.den // self.num, "right") - 1
        signs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for cls in range(max(0, int(least.min(initial=0))), int(most.max(initial=-1)) + 1):
            own = np.flatnonzero((least <= cls) & (cls <= most) & (sizes > 0))
            if not len(own):
                continue
            n, needed = self.fragments(cls), self.needed(cls)
            others = np.minimum(sizes[own] * self.den // self.num, self.largest(cls))
            sent = self.apart(sizes[own], others) + needed
            grams = np.concatenate([sets[i] for i in own])
            place = np.repeat(np.arange(len(own)), sizes[own])
            at = ((grams >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1])]))
            sign = mix(np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins) + mix(at[begins])) << np.uint64(7) | np.uint64(cls)
            place, count = place[begins], np.diff(np.concatenate([begins, [len(grams)]]))
            order = np.lexsort([sign, -count, place])
            sign, place = sign[order], place[order]
            full = np.bincount(place, minlength=len(own))
            rank = np.arange(len(place)) - np.repeat(np.cumsum(full) - full, full)
            keep = rank < sent[place]
            signs.append(sign[keep])
            owners.append(own[place[keep]])
            for i in np.flatnonzero(full < sent):
                size = sizes[own[i]]
                prefix = sets[own[i]][: size - -(-size * self.num // self.den) + self.drawn_out(cls)]
                signs.append(mix(prefix) << np.uint64(7) | np.uint64(CLASSES + cls))
                owners.append(np.full(len(prefix), own[i]))
        return np.concatenate(signs), np.concatenate(owners)


def batch_sets(batch: pa.RecordBatch, join: Join) -> tuple[list[int | None], list[np.ndarray]]:
    return batch.column(0).to_pylist(), join.sets(Texts(batch.column(1), fold=LOWER))


def digest(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(own ^ np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (1, 0x7FFF_FFFF_FFFF))


def summed(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets = batch_sets(batch, join)
        marks = [digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1))],
            names=["doc_id", "n_shingles", "s1", "s2"],
        )


def distinct(sign: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests and documents sorted, without repeats, with their marks; which group of equal digests each is in."""
    order, begins = packed.grouped([sign, doc])
    if not len(order):
        return sign, doc, mark, np.zeros(0, np.int64)
    mark = np.bitwise_or.reduceat(mark[order], begins)
    sign, doc = sign[order[begins]], doc[order[begins]]
    return sign, doc, mark, np.cumsum(np.concatenate([[True], sign[1:] != sign[:-1]])) - 1


def hot_members(sign: np.ndarray, doc: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Of members of large groups, which belong to a document that holds more of a class than it may spare."""
    cls = (sign & np.uint64(127)).astype(np.int64)
    order, begins = packed.grouped([doc, cls])
    count = np.diff(np.concatenate([begins, [len(order)]]))
    hot = np.zeros(len(order), bool)
    hot[order] = np.repeat(count > spare[cls[order[begins]]], count)
    return hot


def sent(batches: Iterator[pa.RecordBatch], join: Join, n: int) -> Iterator[pa.RecordBatch]:
    """Digests by bucket. Of a group that is large in a task already, one digest goes there to say so; its hot
    documents are tied here, the others are sent on as members, dealt by document."""
    signs: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    size = 0
    spare = np.array([join.spare(c) for c in range(2 * CLASSES)])

    def dealt_by(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        sign, doc = np.concatenate(signs), np.concatenate(docs)
        sign, doc, mark, group = distinct(sign, doc, np.zeros(len(sign), np.uint8))
        large = np.flatnonzero((np.bincount(group) > PAIRED)[group])
        hot = hot_members(sign[large], doc[large], spare)
        mark[large] = 1 + 2 * hot
        # one of each large group, a hot one if there is one, stands for it in its bucket
        order = large[np.lexsort([~hot, group[large]])]
        first = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])] if len(order) else order
        stands = np.zeros(int(group[-1]) + 1, np.int64)
        stands[group[first]] = first
        keep = np.ones(len(sign), bool)
        keep[large] = False
        keep[first] = True
        order = np.flatnonzero(keep)[np.argsort(doc[keep], kind="stable")]  # runs of equal documents pack well
        yield packed.split(((sign[order] >> np.uint64(7)) % np.uint64(n)).astype(np.int64), {"sign": sign[order], "doc": doc[order], "mark": mark[order]}, SIGNS)
        tied_now = large[hot]
        a, b = doc[stands[group[tied_now]]], doc[tied_now]
        if (a != b).any():
            forest = Forest()
            for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
                forest.join(x, y)
            edges = np.array(forest.edges, np.int64)
            yield packed.split(dealt_by(edges[:, 1]), {"a": edges[:, 0], "b": edges[:, 1]}, SIGNS)
        others = large[~hot]
        others = others[~keep[others]]
        if len(others):
            yield packed.split(dealt_by(doc[others]), {"member": doc[others], "of": sign[others]}, SIGNS)

    for batch in batches:
        ids, sets = batch_sets(batch, join)
        kept_ids, kept = [], []
        for i, own in zip(ids, sets, strict=True):
            if i is None or not len(own) or (key := digest(own)) in seen:  # equal sets are one class already
                continue
            if len(seen) < 100_000:
                seen.add(key)
            kept_ids.append(i)
            kept.append(own)
        sign, owner = join.signs(kept)
        signs.append(sign)
        docs.append(np.array(kept_ids, np.int64)[owner])
        size += len(sign)
        if size > FLUSH:
            yield from flush()
            signs, docs, size = [], [], 0
    if size:
        yield from flush()


def found_batch(kind: int, a: np.ndarray, b: np.ndarray, cls: np.ndarray | int, n: np.ndarray | int) -> pa.RecordBatch:
    size = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.broadcast_to(cls, size).astype(np.int32)), pa.array(np.broadcast_to(n, size).astype(np.int64))],
        names=["kind", "a", "b", "class", "n"],
    )


def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: pairs of small groups with how many digests they share here, ties, and members of large groups."""
    for got in packed.by_bucket(batches, SIGNS):
        sign, doc, mark, group = distinct(got["sign"], got["doc"], got["mark"])
        forest = Forest()
        for x, y in zip(got["a"].tolist(), got["b"].tolist(), strict=True):
            forest.join(x, y)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        yield found_batch(TIE, edges[:, 0], edges[:, 1], -1, 1)
        yield found_batch(MEMBER, got["member"], got["of"].view(np.int64), (got["of"] & np.uint64(127)).astype(np.int64), 0)
        if not len(sign):
            continue
        flagged = np.zeros(int(group[-1]) + 1, bool)
        flagged[group[(mark & 1) > 0]] = True
        large = (flagged | (np.bincount(group) > PAIRED))[group]
        cls = (sign & np.uint64(127)).astype(np.int64)
        yield found_batch(MEMBER, doc[large], sign[large].view(np.int64), cls[large], mark[large] >> 1)
        doc, group, cls = doc[~large], group[~large], cls[~large]
        for at in range(0, len(doc), PAIRS):  # the pairs whose first place is in this slice
            to = min(at + PAIRS, len(doc))
            pairs = []
            for step in range(1, PAIRED):
                stop = min(to, len(doc) - step)
                same = at + np.flatnonzero(group[at + step : stop + step] == group[at:stop]) if stop > at else np.zeros(0, np.int64)
                if not len(same):
                    break
                pairs.append(np.stack([doc[same], doc[same + step], cls[same]]))
            if pairs:
                a, b, c = np.concatenate(pairs, axis=1)
                order, begins = packed.grouped([a, b, c])
                top = order[begins]
                yield found_batch(PAIR, a[top], b[top], c[top], np.diff(np.concatenate([begins, [len(order)]])))


class Forest:
    """Union-find over any ids; `edges` is a spanning forest of what was joined."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: partial counts of each fragment of the order, summed per pair."""
    out = np.zeros((len(left), len(right)), np.float32)
    grams = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    place = np.cumsum(new) - 1
    often = np.bincount(place) > 1
    keep = often[place]
    place, owner = (np.cumsum(often) - 1)[place[keep]], owner[keep]
    n = int(often.sum())
    cuts = np.searchsorted(place, np.arange(0, n + FRAGMENT, FRAGMENT))
    for f in range(len(cuts) - 1):
        own, at = owner[cuts[f] : cuts[f + 1]], place[cuts[f] : cuts[f + 1]] - f * FRAGMENT
        there = np.zeros((len(left) + len(right), FRAGMENT), np.float32)
        there[own, at] = 1
        out += there[: len(left)] @ there[len(left) :].T
    return out


def verified(ids: list[int], sets: list[np.ndarray], sides: list[int], join: Join, forest: Forest) -> None:
    """Join what links: all pairs if there is one side only, else those across."""
    left = [i for i, s in enumerate(sides) if s == 0]
    right = [i for i, s in enumerate(sides) if s == 1] or left
    if not left:
        return
    both = overlaps([sets[i] for i in left], [sets[i] for i in right])
    sizes = np.array([len(s) for s in sets], np.float64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    for row, found in enumerate(join.den * both.astype(np.float64) >= join.num * union):
        for col in np.flatnonzero(found).tolist():
            forest.join(ids[left[row]], ids[right[col]])


def spread(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    """Each member's set, to each block pair it takes part in (columns 2 and 3: cluster, structs of lo, hi and side)."""
    names = ["cluster", "lo", "hi", "side", "doc", "own"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        ids, sets = batch_sets(batch, join)
        rows, held = [], 0
        for i, own, cluster, places in zip(ids, sets, *(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
            data = own.astype("<u8").tobytes()
            for place in places:
                rows.append((cluster, place["lo"], place["hi"], place["side"], i, data))
                held += len(data)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def links(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    """The linked pairs of each block pair, as a spanning forest; rows come sorted by block pair."""
    now, ids, sets, sides = None, [], [], []
    edges: list[tuple[int, int]] = []

    def done() -> None:
        if now is not None:
            forest = Forest()
            verified(ids, sets, sides, join, forest)
            edges.extend(forest.edges)

    for batch in batches:
        for cluster, lo, hi, side, doc, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (cluster, lo, hi) != now:
                done()
                now, ids, sets, sides = (cluster, lo, hi), [], [], []
                if len(edges) > 100_000:
                    yield edge_batch(edges)
                    edges.clear()
            ids.append(doc)
            sets.append(np.frombuffer(own, "<u8"))
            sides.append(side)
    done()
    yield edge_batch(edges)


def met(texts: DataFrame, members: DataFrame, join: Join) -> DataFrame:
    """Linked pairs (a spanning forest) of members (member, cluster, places) whose places meet."""
    n = packed.partitions(texts.sparkSession)
    # a merge join at every size: the members' side grows with the corpus
    chosen = texts.join(members.hint("merge"), F.col("doc_id") == F.col("member")).select("doc_id", "text", "cluster", "places")
    rows = chosen.mapInArrow(lambda it: spread(it, join), "cluster long, lo int, hi int, side int, doc long, own binary")
    rows = rows.repartition(n, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    return rows.mapInArrow(lambda it: links(it, join), "a long, b long")


def blocks(members: DataFrame) -> DataFrame:
    """By cluster, how many blocks its members (n_shingles) are cut into, where there are two members or more."""
    stats = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("grams")).where("m > 1")
    return stats.select("cluster", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("k"))


def linked(texts: DataFrame, members: DataFrame, join: Join) -> DataFrame:
    """(v, component) of the linked members of clusters; members: member, n_shingles, cluster."""
    block = F.pmod(F.xxhash64("member"), F.col("k")).cast("int")
    place = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(side).alias("side"))
    sized = members.join(blocks(members), "cluster").withColumn("block", block)
    pivots = sized.where("k > 1").groupBy("cluster").agg(F.array_distinct(F.array(*(F.min_by("member", F.xxhash64("member", F.lit(i))) for i in range(PIVOTS)))).alias("pivots"))
    first = sized.join(pivots, "cluster", "left")
    # a pivot goes to every block, others to their own
    everywhere = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda b: place(b, b, 0))
    first = first.withColumn("places", F.when(F.array_contains("pivots", F.col("member")), everywhere).otherwise(F.array(place(F.col("block"), F.col("block"), 0))))
    edges = saved(met(texts, first, join), "links")
    groups = components(edges)
    wide = saved(sized.where("k > 1").join(groups, F.col("member") == F.col("v"), "left").select("cluster", "member", "n_shingles", "block", "k", F.coalesce("component", "member").alias("group")), "wide")
    main = wide.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    wide = wide.join(main, "cluster")
    outside = wide.where("group <> main").groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("grams"))
    outside = outside.select("cluster", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("j"))
    if outside.isEmpty():
        return groups
    rest = wide.join(outside, "cluster").withColumn("own", F.pmod(F.xxhash64("member", F.lit("own")), F.col("j")).cast("int"))
    all_outside = F.transform(F.sequence(F.lit(0), F.col("j") - 1), lambda b: place(b, F.col("block"), 1))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda b: place(F.col("own"), b, 0))
    rest = rest.withColumn("places", F.when(F.col("group") != F.col("main"), F.concat(all_outside, all_blocks)).otherwise(all_outside))
    return components(edges.union(met(texts, rest, join)))


def candidates(texts: DataFrame, join: Join, n: int) -> DataFrame:
    """Edges a, b that tie all sets that may link; n buckets."""
    sent_on = texts.mapInArrow(lambda it: sent(it, join, n), packed.schema(SIGNS))
    dealt = packed.dealt(sent_on).sortWithinPartitions("bucket")
    found = saved(dealt.mapInArrow(tied, "kind int, a long, b long, class int, n long"), "pairs")
    by_class = lambda f: F.get(F.array(*(F.lit(int(f(c))) for c in range(2 * CLASSES))), F.col("class"))
    enough = by_class(lambda c: join.needed(c) - join.spare(c))
    counted = found.where(F.col("kind") == PAIR).groupBy("a", "b", "class").agg(F.sum("n").alias("n")).where(F.col("n") >= enough)
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("doc"), F.col("b").alias("sign"), "class", "n")
    held = Window.partitionBy("doc", "class")
    hot = members.withColumns({"held": F.count(F.lit(1)).over(held), "marked": F.max("n").over(held)})
    hot = hot.where((F.col("marked") > 0) | (F.col("held") > by_class(join.spare))).select("doc", "sign")
    stars = hot.join(hot.groupBy("sign").agg(F.min("doc").alias("least")), "sign").where("doc <> least").select("doc", "least").distinct()
    return found.where(F.col("kind") == TIE).select("a", "b").union(counted.select("a", "b")).union(stars)


def jaccard_join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    join = Join(words, num, den)
    texts = texts_of(docs)
    sizes = saved(texts.mapInArrow(lambda it: summed(it, join), "doc_id long, n_shingles long, s1 long, s2 long"), "sets")
    classes = sizes.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    own = sizes.where("n_shingles > 0 and doc_id is not null").join(classes, ["s1", "s2"]).select("doc_id", "n_shingles", "rep")
    own = saved(own, "classes")

    # each class sends at most half as many digests as a set has n-grams, in about 1.5 classes: buckets follow the data's size
    total = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n = max(4 * packed.partitions(spark), int(total * (den - num) / (den + num) * 4 / BUCKET))
    same = own.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    clusters = components(candidates(texts, join, n).union(same))
    members = own.where("doc_id = rep").select("doc_id", "n_shingles").distinct().join(clusters, F.col("doc_id") == F.col("v"))
    members = saved(members.select(F.col("doc_id").alias("member"), "n_shingles", F.col("component").alias("cluster")), "members")
    groups = linked(texts, members, join)

    found = own.join(groups, F.col("rep") == F.col("v"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sizes.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive pattern as (select '[^\x20\x09-\x0D]+' p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' u, 'abcdefghijklmnopqrstuvwxyz' l),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) w from documents, pattern),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
j as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from j join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from e union all select b, a from e),
reach(v, r) as (select doc_id, doc_id from d union select b, r from reach join both_ways on v = a)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, component_id
from d left join n using (doc_id) join (select v doc_id, min(r) component_id from reach group by v) using (doc_id)
"""
