"""The search index table, ranked search over it, and the meaning of a query.

The index is built once, with its keys, when documents change; a search is then one narrow scan of keys and values and a
sort of the hits.

Defined results: an empty query finds nothing; null texts, titles and values match no word and no amount; documents
without facts or obligations are found by their text; repeated documents are found row by row; equal scores go by
doc_id; an empty index gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.parsers import MONTHS, amounts, dates, grouped_numbers, loose_amount
from . import review
from .tables import dealt


@dataclass(frozen=True)
class Query:
    raw: str
    tokens: tuple[str, ...]
    minor: int | None
    day: date | None
    month: int | None
    year: int | None


def query_of(raw: str) -> Query:
    """What a search text means: words, an amount, a date or a month."""
    text = raw.strip()
    tokens = tuple(re.sub(r"[^\w₹]+|_", " ", text.lower()).split())
    found = dates(text)
    day = found[0].day if found else None
    month = year = None
    if len(tokens) <= 2:
        if day is None:
            month = next((i for t in tokens if len(t) >= 3 for i, m in enumerate(MONTHS, 1) if m.startswith(t) or t == "sept" and i == 9), None)
        year = next((int(t) for t in tokens if t.isdigit() and 1990 <= int(t) <= 2100), None)
    low = text.lower()
    bare = text.isdigit() and int(text) >= 100 and not 1990 <= int(text) <= 2100
    money = "₹" in text or low.startswith(("rs", "inr")) or "," in text or "lakh" in low or "crore" in low or low.endswith("k") or bare
    amount = loose_amount(text) if money and day is None else None
    return Query(raw, tokens, amount and amount[0], day, month, year)


def has_word(text: Column, token: str, prefix: bool) -> Column:
    """The token as a whole word of an index key, or as a word's beginning."""
    return text.rlike(r"(?<![\p{L}\p{N}])\Q" + token + r"\E" + ("" if prefix else r"(?![\p{L}\p{N}])"))


def indexed(index: DataFrame) -> DataFrame:
    """The index with the keys that searches read; made once, when documents change, and stored with it."""
    name = F.concat_ws(" ", "title", "filename") if "filename" in index.columns else F.col("title")
    kind = F.concat_ws(" ", "kind", F.array_join("tags", " ")) if "tags" in index.columns else F.col("kind")
    return index.select(
        "*", C.search_key(name).alias("k_title"), C.search_key(F.array_join("parties", " | ")).alias("k_parties"), C.search_key(kind).alias("k_kind"),
        F.transform("fields", lambda f: C.search_key(F.concat_ws(" ", f["label"], f["value"]))).alias("k_fields"),
        F.transform("obligations", lambda o: C.search_key(F.concat_ws(" ", o["title"], o["status"]))).alias("k_obligations"),
    )


def text_amounts(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct amounts written in docs(doc_id, full_text), marked ones and grouped numbers."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            amounts_of = lambda t: sorted({m.minor for m in amounts(t)} | set(grouped_numbers(t)))
            values = [amounts_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "text_amounts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("full_text").cast("string").alias("full_text"))
    return dealt(rows).mapInArrow(found, "doc_id long, text_amounts array<bigint>")


def build(documents: DataFrame, facts: DataFrame, obligations: DataFrame, today: Column) -> DataFrame:
    """The index table, with keys, of documents(doc_id, title, filename, document_type, tags, full_text), their facts that aren't
    rejected and their obligations by effective status. Documents without facts or obligations are found by their text."""
    own = review.not_rejected(facts)
    names = F.create_map(*(F.lit(x) for pair in review.KIND_NAMES.items() for x in pair))
    field = F.struct(names[F.col("kind")].alias("label"), review.search_text().alias("value"), "minor", "day")
    fields = own.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("no", field.alias("f")))), lambda x: x["f"]).alias("fields"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "party", F.struct("no", "text")))), lambda x: x["text"]).alias("parties"),
    )
    duty = F.struct(F.concat_ws(" ", "title", "counterparty").alias("title"), C.effective_status(F.col("status"), F.col("due_date"), today).alias("status"), F.col("amount_minor").alias("minor"), F.col("due_date").alias("day"))
    duties = obligations.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("obligation_id", duty.alias("o")))), lambda x: x["o"]).alias("obligations"))
    rows = documents.join(fields, "doc_id", "left").join(duties, "doc_id", "left").join(text_amounts(documents), "doc_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    value = "minor:bigint,day:date"
    rows = rows.select(
        "doc_id", "title", "filename", "tags", F.replace(F.coalesce("document_type", F.lit("")), F.lit("_"), F.lit(" ")).alias("kind"), empty("parties", "string"), empty("fields", f"struct<label:string,value:string,{value}>"),
        empty("obligations", f"struct<title:string,status:string,{value}>"), C.search_key(F.col("full_text")).alias("body_key"), empty("text_amounts", "bigint"),
    )
    return indexed(rows)


def hydrated(results: DataFrame, documents: DataFrame, raw: str) -> DataFrame:
    """Results with their documents and a snippet: around the first word of the query, else around its month's name."""
    q = query_of(raw)
    words = [t for t in (q.tokens[:1] + ((MONTHS[q.month - 1],) if q.month else ()))]
    own = results.join(documents, "doc_id")
    return own.withColumn("snippet", F.coalesce(*(snippet(F.col("full_text"), w) for w in words), F.lit(None).cast("string")))


def search(index: DataFrame, raw: str) -> DataFrame:
    """index(doc_id, title, parties array, kind, fields array<struct<label,value,minor,day>>,
    obligations array<struct<title,status,minor,day>>, body_key, text_amounts array<bigint>; filename and tags if it has them), best
    `indexed` -> doc_id, score; best first."""
    q = query_of(raw)
    if not q.tokens and q.minor is None:
        return index.where("false").select("doc_id", F.lit(0.0).alias("score"))
    zero = F.lit(0.0)
    count = lambda array, test: F.size(F.filter(array, lambda x: F.coalesce(test(x), F.lit(False)))).cast("double")
    amount = zero
    if q.minor is not None:
        same = lambda x: x["minor"] == q.minor
        amount = 6 * count("fields", same) + 5 * count("obligations", same) + F.when(F.array_contains("text_amounts", q.minor), 3.0).otherwise(0.0)
    on_day = zero
    if q.day or q.month:
        hit = (lambda x: x["day"] == F.lit(q.day)) if q.day else (lambda x: (F.month(x["day"]) == q.month) & (F.lit(q.year is None) | (F.year(x["day"]) == (q.year or 0))))
        on_day = 4 * count("fields", hit) + 4 * count("obligations", hit)
    keys = index if "k_title" in index.columns else indexed(index)
    text, found_all = zero, F.lit(bool(q.tokens))
    for i, token in enumerate(q.tokens):
        last = i == len(q.tokens) - 1
        has = lambda c: F.when(has_word(F.col(c), token, last), 1.0).otherwise(0.0)  # noqa: B023,E731
        many = lambda c: count(c, lambda x: has_word(x, token, last))  # noqa: B023,E731
        score = 5 * has("k_title") + 4 * has("k_parties") + 2 * has("k_kind") + 2 * many("k_fields") + 2 * many("k_obligations") + has("body_key")
        text, found_all = text + score, found_all & (score > 0)
    phrase = " ".join(q.tokens)
    if len(q.tokens) > 1:
        text = text + F.when(F.contains("k_title", F.lit(phrase)) | F.contains("k_parties", F.lit(phrase)), 5.0).otherwise(0.0)
    score = F.when(amount > 0, amount).otherwise(on_day + F.when(found_all, text).otherwise(0.0))
    return keys.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id")


def snippet(text: Column, token: str) -> Column:
    """Up to 60 characters on either side of the first hit, on one line."""
    at = F.instr(C.folded(text), token)
    a, b = F.greatest(F.lit(1), at - 60), F.least(F.length(text), at + len(token) - 1 + 60)
    body = C.collapsed(F.substring(text, a, b - a + 1))
    return F.when(at > 0, F.concat(F.when(a > 1, "…").otherwise(""), body, F.when(b < F.length(text), "…").otherwise("")))
