"""Documents to facts: rules, an optional model's facts, merging, dates, confidence, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import layout, lifecycle, model, review
from ..operators.extract import extract_facts
from ..operators.tables import written

#: Order in which kinds are shown.
KINDS = "document_type title party effective_date end_date notice_period renewal total_amount payment payment_frequency obligation clause identifier".split()
#: A provider takes (doc_id, chunk, full_text) and gives (doc_id, chunk, response) with the model's JSON.
Provider = Callable[[DataFrame], DataFrame]
#: Characters of a chunk for models that read little at once.
CHUNK = 5_000
EMPTY = "No readable text was found in this document."


def with_confidence(facts: DataFrame) -> DataFrame:
    missing = F.col("anchor").isNotNull() & F.col("base_date").isNull()
    level = C.confidence(
        F.col("origin"), F.col("at").isNotNull(), F.col("strength"), F.col("match"), F.col("verified"), F.col("ocr"), F.coalesce("ambiguous", F.lit(False)), missing, F.coalesce("conflict", F.lit(False))
    )
    return facts.withColumn("confidence", level)


def unreadable(docs: DataFrame) -> DataFrame:
    """doc_id and warning of documents without text; no rule or model reads them."""
    return docs.where(F.coalesce(F.trim("full_text"), F.lit("")) == "").select("doc_id", F.lit(EMPTY).alias("warning"))


def asked(docs: DataFrame, provider: Provider, pages: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """A provider's answers about docs(doc_id, full_text): whole texts, or with `size` their pages(doc_id, page, text) packed into chunks."""
    readable = docs.where(F.trim("full_text") != "")
    if size is None or pages is None:
        return provider(readable.select("doc_id", F.lit(0).alias("chunk"), "full_text"))
    packed = layout.chunk_texts(pages.join(readable.select("doc_id").distinct(), "doc_id", "left_semi"), size)
    return provider(packed.select("doc_id", "chunk", F.col("text").alias("full_text")))


def read_documents(docs: DataFrame, model_facts: DataFrame | None = None) -> DataFrame:
    """Facts of docs(doc_id, full_text), scored, with relative dates resolved, in order of presentation.
    Without model facts (see operators.model.facts_of) the rules stand alone. Documents without text have no facts."""
    rules = extract_facts(docs.where(F.trim("full_text") != ""))
    facts = written(lifecycle.merged(written(rules, "rule-facts"), written(model_facts, "model-facts")), "facts") if model_facts is not None else rules.withColumns({"origin": F.lit("rules"), "conflict": F.lit(False)})
    own = set(facts.columns)
    facts = facts.withColumns({
        "match": F.coalesce("match", F.lit("exact")) if "match" in own else F.lit("exact"), "verified": F.col("verified") if "verified" in own else F.lit(None).cast("boolean"),
        "ocr": F.lit(None).cast("double"), "verification": F.lit("pending"), "base_date": F.lit(None).cast("date"),
    })
    facts = with_confidence(facts).drop("base_date")
    facts = with_confidence(lifecycle.resolve_relative(facts))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = Window.partitionBy("doc_id").orderBy(rank, F.col("day").asc_nulls_last(), "at", "no")
    return facts.withColumn("sort_index", F.row_number().over(order) - 1)


def read_with(docs: DataFrame, provider: Provider, pages: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """As read_documents, with what a provider's model finds."""
    return read_documents(docs, model.facts_of(asked(docs, provider, pages, size), docs))


def read_again(docs: DataFrame, existing: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Documents read anew; what the user has decided about their facts stays."""
    fresh = read_with(docs, provider) if provider else read_documents(docs)
    return review.reapplied(existing, fresh)


def response_of(text_col: str = "response") -> Column:
    """The JSON object inside a model's answer, whatever surrounds it."""
    return F.regexp_extract(F.col(text_col), r"(?s)\{.*\}", 0)
