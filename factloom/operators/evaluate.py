"""Extraction quality against labels.

Defined results: nothing expected and nothing found is perfect, one of them empty scores 0; null keys are values like
any other in bags and never match in joins; repeated rows count as often as they occur; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def multiset_f1(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Per document F1 of two bags of keys: of each key the smaller count matches."""
    a = expected.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("want"))
    b = got.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("have"))
    both = a.join(b, ["doc_id", *keys], "full_outer").fillna(0, ["want", "have"])
    sums = both.groupBy("doc_id").agg(F.sum(F.least("want", "have")).alias("matched"), F.sum("want").alias("want"), F.sum("have").alias("have"))
    return sums.select("doc_id", C.f1(F.col("matched"), F.col("want"), F.col("have")).alias("f1"))


def macro(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean over documents of each document's ratio, and the number of documents."""
    per_doc = scores.groupBy(*by, "doc_id").agg((F.sum("right") / F.sum("total")).alias("ratio"))
    return per_doc.groupBy(*by).agg(F.avg("ratio").alias("score"), F.count(F.lit(1)).alias("n_docs"))


def accuracy(judged: DataFrame) -> DataFrame:
    """judged(doc_id, field, right, confidence): per field how many are right of how many, and the wrong ones of high confidence."""
    wrong = (F.col("right") == 0) & F.col("confidence").eqNullSafe("high")
    return judged.groupBy("field").agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("total"), F.count_if(wrong).alias("high_errors"))


def combined(scores: DataFrame, parts: list[str], name: str) -> DataFrame:
    """scores(doc_id, field, right, total) and, for each document, one field more: the sum of some of its fields."""
    own = scores.where(F.col("field").isin(parts)).groupBy("doc_id").agg(F.sum("right").alias("right"), F.sum("total").alias("total"))
    return scores.select("doc_id", "field", "right", "total").unionByName(own.withColumn("field", F.lit(name)))


#: Kinds whose place in the text proves nothing.
UNPLACED = ["clause", "title", "document_type"]


def source_matching(facts: DataFrame) -> DataFrame:
    """Per document the share of facts that point at text which bears them out: found, not only nearly, and not refuted."""
    ok = F.col("at").isNotNull() & ~F.col("match").eqNullSafe("fuzzy") & ~F.col("verified").eqNullSafe(False)
    return facts.where(~F.col("kind").isin(UNPLACED)).groupBy("doc_id").agg(F.sum(ok.cast("int")).alias("right"), F.count(F.lit(1)).alias("total"))


def identifier_f1(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per document F1 of expected and found identifiers (doc_id, value): distinct values match, all found ones count."""
    want, have = (d.groupBy("doc_id").agg(F.collect_list("value").alias(n)) for d, n in ((expected, "want"), (got, "have")))
    both = want.join(have, "doc_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return both.select("doc_id", C.f1(F.size(F.array_intersect("want", "have")), F.size("want"), F.size("have")).alias("f1"))
