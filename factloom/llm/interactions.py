"""Filter interaction audit: what each filter removes, and what others would have removed, in every order of the filters.

Documents fall into cells by the set of filters that they fail (a bit mask), counted per part; all
figures of an order follow from the cells. The orders of a part are visited by adjacent transpositions: each next one
swaps two neighbours, so only those two steps are worked out again, and a filter's Shapley sum grows along
the walk by what it removed since its step last changed. The cells of a part are at most 2 ** len(FILTERS) rows.

Defined results: a null text counts as empty; a null source is the part "", together with empty ones; rows that share
doc_id and text are judged alike, and none of them is the other's copy; a null doc_id is nobody's copy and has no
label; a doc_id labelled several times is good (toxic) if one of its labels says so; an empty table has no parts and gives no
rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table

FILTERS = "ABCDE"
#: Parameters of the filters: fewest words, distinct words and capitals in percent, characters that fail.
MIN_WORDS, DISTINCT_PCT, CAPITALS_PCT, SIGNS = 50, 65, 5, "#$%&*|"
MEASURES = ("n", "good", "toxic")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def swaps(k: int) -> Iterator[int]:
    """Places i whose swaps with i + 1 lead through all orders of k things, one after another."""
    if k < 2:
        return
    inner, leftward = swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if leftward else range(k - 1)  # the last thing wanders through the others
        place = next(inner, None)
        if place is None:
            return
        yield place + leftward  # once it stands in front, the others begin a place further on
        leftward = not leftward


def walk(cells: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """The orders, and per order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    cells[mask] holds the counts (n, good, toxic) of the documents that fail exactly the filters of mask.
    """
    k = len(filters)
    masks, total = np.arange(1 << k), int(cells[:, 0].sum())
    fails = [int(cells[(masks >> f) & 1 == 1, 0].sum()) for f in range(k)]
    order = list(range(k))
    steps = np.zeros((k, 6), np.int64)

    def redo(i: int) -> None:
        f, before = order[i], sum(1 << g for g in order[:i])
        removed, good, toxic = cells[(masks & before == 0) & ((masks >> f) & 1 == 1)].sum(axis=0)
        left = steps[i - 1, 0] if i else total
        steps[i] = left - removed, removed, fails[f] - removed, cells[1 << f, 0], good, toxic

    for i in range(k):
        redo(i)
    names, out, shapley, since = ["".join(filters[f] for f in order)], [steps.copy()], [0] * k, [0] * k
    for at, i in enumerate(swaps(k), 1):
        for j in (i, i + 1):
            shapley[order[j]] += int(steps[j, 1]) * (at - since[order[j]])
            since[order[j]] = at
        order[i], order[i + 1] = order[i + 1], order[i]
        redo(i)
        redo(i + 1)
        names.append("".join(filters[f] for f in order))
        out.append(steps.copy())
    for j, f in enumerate(order):
        shapley[f] += int(steps[j, 1]) * (len(names) - since[f])
    sums = np.array([[shapley[filters.index(c)] for c in name] for name in names], np.int64)
    return names, np.concatenate([np.array(out), sums[:, :, None]], axis=2)


def audited(batches: Iterator[pa.RecordBatch], filters: str) -> Iterator[pa.RecordBatch]:
    """All orders of each part of a batch."""
    k = len(filters)
    for batch in batches:
        for row in batch.to_pylist():
            cells = np.zeros((1 << k, len(MEASURES)), np.int64)
            for c in row["cells"]:
                cells[c["mask"]] += [c[m] for m in MEASURES]
            names, values = walk(cells, filters)
            columns = [[row["part"]] * len(names) * k, np.repeat(names, k).tolist(), np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))]
            columns += list(values.reshape(-1, values.shape[2]).T)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in AUDIT.split(", ")])


def audit(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters per part; flagged has a row per document: part, mask (bit i: it fails filter i), good, toxic."""
    ship(flagged.sparkSession)
    cells = flagged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return parts.mapInArrow(lambda it: audited(it, filters), AUDIT)


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters that look at one text alone (A to D)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", CAPITALS, ""))
    fails = [
        n < MIN_WORDS,
        F.lit(100).cast("long") * distinct < F.lit(DISTINCT_PCT).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(CAPITALS_PCT).cast("long") * F.length("text"),
        F.col("text").rlike(f"[{SIGNS}]"),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document.

    Copies are told by the SHA-256 of the text. Of a text's documents the smallest doc_id is found by an aggregation and met on
    (digest, doc_id), so that a text of many copies is spread by their ids.
    """
    rows = saved(text_failures(docs), "filter-failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    met = rows.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return met.select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = f"""
with m as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
f as (select doc_id, part, case when len(w) < {MIN_WORDS} then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < {DISTINCT_PCT} * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PCT} * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[{SIGNS}]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end mask from d),
c as (select part, mask, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from f left join m using (doc_id) group by part, mask),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o as (select l1.x || l2.x || l3.x || l4.x || l5.x filter_order from l l1, l l2, l l3, l l4, l l5 where l1.b | l2.b | l3.b | l4.b | l5.b = 31),
p as (select filter_order, step, x, b, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: case y when 'A' then 1 when 'B' then 2 when 'C' then 4 when 'D' then 8 when 'E' then 16 else 0 end)) before
  from o, unnest(range(1, 6)) s(step) join l on x = filter_order[step]),
q as (select distinct part from c),
r as (select q.part, filter_order, step, x,
  coalesce(sum(n) filter (mask & (coalesce(before, 0)::int | b) = 0), 0)::bigint kept,
  coalesce(sum(n) filter (mask & b <> 0 and mask & coalesce(before, 0)::int = 0), 0)::bigint removed,
  coalesce(sum(n) filter (mask & b <> 0 and mask & coalesce(before, 0)::int <> 0), 0)::bigint redundant,
  coalesce(sum(n) filter (mask = b), 0)::bigint unique_fails,
  coalesce(sum(good) filter (mask & b <> 0 and mask & coalesce(before, 0)::int = 0), 0)::bigint good_lost,
  coalesce(sum(toxic) filter (mask & b <> 0 and mask & coalesce(before, 0)::int = 0), 0)::bigint toxic_lost
  from q join c using (part), p group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, x)::bigint shapley from r
"""
