"""Line dedup by content-defined chunks, in DataFrame expressions only.

Each line has a 48-bit hash; a rolling hash over two lines in a row hits whenever it is divisible by
DIVISOR. A chunk ends after a line where the hash hits and that of the line before does not, and
never directly before the last line, so boundaries move with the lines and not with their position,
and every chunk of a text of two lines or more has at least two. A chunk of at least MIN_LINES lines,
one of them not blank, that occurs anywhere before (smaller doc_id, then earlier in the document) is
removed once its bytes have been compared with those of its first occurrence. So an exact copy of a
text of several lines leaves nothing but blank chunks.

With `whole=False` a chunk ends after every line where the hash hits; it may then be one line, and
such a chunk is never removed.

Steps: hashes of chunks alone are counted (pre-aggregated before the shuffle); texts move once to
meet the marks of repeated chunks, which are compared byte for byte with the first occurrence, and
once more to take the verdicts. Joins on the hash of a very frequent chunk are ones that adaptive
execution splits.

Defined results: a null text stays null and counts as one blank line; rows that agree in doc_id and
text are one document and get one verdict; null doc_ids come last in the order; an empty table
gives no rows. A text all of whose lines are removed is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, saved, table

DIVISOR = 3
MIN_LINES = 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 12), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key (a hash of the text, to tell rows of one id apart)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def with_chunks(rows: DataFrame, whole: bool = True) -> DataFrame:
    """Adds lines, and stops: the line after which each chunk ends.

    Each array is used as a whole: inside a lambda the optimizer would put its whole expression, to
    be computed again for every element.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    marks = F.transform(lines, line_hash)
    ends = F.zip_with(marks, F.concat(F.array(F.lit(None).cast("long")), marks), lambda now, before: (before * 31 + now) % DIVISOR == 0)
    stops = F.filter(F.transform(ends, lambda end, i: F.when(end, i + 1)), lambda x: x.isNotNull())
    if whole:
        rows = rows.withColumn("hits", stops)
        stops = F.array_remove(F.array_except("hits", F.transform("hits", lambda x: x + 1)), F.size(lines) - 1)
    return rows.withColumn("lines", lines).withColumn("stops", F.array_distinct(F.concat(stops, F.array(F.size(lines))))).drop("hits")


def chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk that may be removed: doc_id, key, no, chunk."""
    # outer, though no array is empty: no filter that finds the chunks a second time is inferred
    out = rows.select("doc_id", "key", "lines", F.posexplode_outer("stops").alias("no", "stop"), F.col("stops").alias("all_stops"))
    begin = F.coalesce(F.get("all_stops", F.col("no") - 1), F.lit(0))
    out = out.select("doc_id", "key", "no", F.slice("lines", begin + 1, F.col("stop") - begin).alias("own")).where(F.size("own") >= MIN_LINES)
    return out.select("doc_id", "key", "no", F.array_join("own", "\n").alias("chunk")).where(F.col("chunk").rlike(r"\S"))


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "no")


def repeated(docs: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, key, no of each chunk to remove."""
    hashed = chunks(with_chunks(keyed(docs), whole)).select(
        "doc_id", "key", "no", F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit(7), "chunk").alias("h2")
    )
    groups = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first")).where("n > 1")
    met = hashed.join(groups, ["h1", "h2"]).select("doc_id", "key", "no", "h1", "h2", (place() == F.col("first")).alias("is_first"))
    wanted = met.groupBy("doc_id", "key").agg(F.collect_set(F.struct("no", "h1", "h2", "is_first")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "wanted")
    rows = keyed(docs).join(wanted, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")))
    rows = with_chunks(rows, whole).select("doc_id", "key", "lines", "stops", F.explode("wanted").alias("w"))
    begin = F.coalesce(F.get("stops", F.col("w.no") - 1), F.lit(0))
    own = F.array_join(F.slice("lines", begin + 1, F.get("stops", F.col("w.no")) - begin), "\n")
    texts = saved(rows.select("doc_id", "key", "w.no", "w.h1", "w.h2", "w.is_first", own.alias("chunk")), "line-chunks")
    firsts = texts.where("is_first").select("h1", "h2", F.col("chunk").alias("first_chunk")).dropDuplicates(["h1", "h2"])
    return texts.where("not is_first").join(firsts, ["h1", "h2"]).where("chunk = first_chunk").select("doc_id", "key", "no")


def line_dedup(docs: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_removed of every row of docs, and its other columns in `rest`."""
    marks = repeated(docs, whole).groupBy("doc_id", "key").agg(F.collect_set("no").alias("gone"))
    marks = marks.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "gone")
    rows = carried(docs).withColumn("key", F.xxhash64("text")).join(marks, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    rows = with_chunks(rows.select("doc_id", "text", "rest", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")), whole)
    begins = F.concat(F.array(F.lit(0)), F.col("stops"))
    spans = F.transform(F.arrays_zip(begins.alias("a"), F.col("stops").alias("b")), lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("no")))
    left = F.flatten(
        F.transform(
            F.filter("spans", lambda x: x["b"].isNotNull() & ~F.array_contains("gone", x["no"])),
            lambda x: F.slice("lines", x["a"] + 1, x["b"] - x["a"]),
        )
    )
    # exploding one row to one row keeps the arrays from being put into the lambdas above
    own = F.struct(F.col("text").isNull().alias("is_null"), "lines", "gone", spans.alias("spans"))
    cut = rows.select("doc_id", "rest", F.explode(F.array(own)).alias("own")).select("doc_id", "rest", "own.*")
    cut = cut.select("doc_id", "rest", "is_null", F.size("lines").alias("n"), left.alias("left"))
    return cut.select(
        "doc_id",
        F.when(~F.col("is_null"), F.array_join("left", "\n")).alias("text"),
        F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.size("left")).cast("long").alias("n_removed"),
        "rest",
    )


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(line_dedup(table(spark, sf_dir, "documents")))


def line_chunks_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10_line_chunks, by chunks that may be one line."""
    return digests(line_dedup(table(spark, sf_dir, "documents"), whole=False))


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
m as (select doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 12))::bigint) m from d),
h as (select doc_id, l, list_transform(range(1, len(l) + 1), lambda i: i > 1 and (m[greatest(i - 1, 1)] * 31 + m[i]) % {DIVISOR} = 0) h from m),
s as (select doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) or (i <> len(l) - 1 and h[i] and not h[greatest(i - 1, 1)])) s from h),
c as (select doc_id, l, s, unnest(range(1, len(s) + 1)) k from s),
t as (select doc_id, k, case when k = 1 then 0 else s[k - 1] end a, s[k] b, l from c),
x as (select doc_id, k, b - a n, array_to_string(l[a + 1:b], chr(10)) txt from t),
r as (select *, n >= {MIN_LINES} and regexp_matches(txt, '[^ \\t\\n\\x0B\\f\\r]') ok from x),
g as (select *, ok and row_number() over (partition by ok, txt order by doc_id, k) > 1 gone from r)
select doc_id, sum(n)::bigint n_lines, coalesce(sum(n) filter (gone), 0)::bigint n_removed,
  sha256(coalesce(string_agg(txt, chr(10) order by k) filter (not gone), '')) kept_sha256
from g group by doc_id
"""

#: As OP10_SQL, by the rule of whole=False.
ANY_SQL = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
m as (select doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 12))::bigint) m from d),
s as (select doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) or (i > 1 and (m[greatest(i - 1, 1)] * 31 + m[i]) % {DIVISOR} = 0)) s from m),
c as (select doc_id, l, s, unnest(range(1, len(s) + 1)) k from s),
t as (select doc_id, k, case when k = 1 then 0 else s[k - 1] end a, s[k] b, l from c),
x as (select doc_id, k, b - a n, array_to_string(l[a + 1:b], chr(10)) txt from t),
r as (select *, n >= {MIN_LINES} and regexp_matches(txt, '[^ \\t\\n\\x0B\\f\\r]') ok from x),
g as (select *, ok and row_number() over (partition by ok, txt order by doc_id, k) > 1 gone from r)
select doc_id, sum(n)::bigint n_lines, coalesce(sum(n) filter (gone), 0)::bigint n_removed,
  sha256(coalesce(string_agg(txt, chr(10) order by k) filter (not gone), '')) kept_sha256
from g group by doc_id
"""
