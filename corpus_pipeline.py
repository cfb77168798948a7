"""A corpus pipeline of five stages over documents; each stage's result is written and read again.

quality rules -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> BPE encoding.
All but the last return the columns of documents. Defined results: very long texts are read whole;
an empty input gives an empty result of the same columns; columns beyond those of documents, also
ones named like an operator's own, are carried along untouched. Nulls, ties and repeated rows by
stage: see each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import bpe
from factloom.llm.common import restored, saved, table
from factloom.llm.decontaminate import decontaminate
from factloom.llm.jaccard import jaccard_join
from factloom.llm.linededup import line_dedup
from factloom.llm.quality import quality

#: Near-duplicate stage: word shingles and similarity.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the base rules and the likelihood ratio keep.

    Null and empty texts have too few words and go; repeated rows get one verdict; a score that ties with the threshold is kept.
    """
    return restored(quality(docs, table(spark, sf_dir, "labels"), keep_rows=True).where("kept"), docs.columns)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated line chunks out of the texts; a document of which only white space is left goes.

    Null texts stay; of chunks that tie the one of the smallest doc_id, then the earliest, stays; rows that agree in doc_id and
    text are one document and get one verdict; null doc_ids come last.
    """
    out = restored(line_dedup(docs).where(F.expr(r"n_removed = 0 or text rlike '\\S'")), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates its smallest doc_id stays.

    Null and empty texts and null doc_ids are in no group and stay; rows that share a doc_id are one document and stay or go together.
    """
    found = jaccard_join(docs, SHINGLE_WORDS, *SIMILAR)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window.

    Null and empty texts hold none; rows that share a doc_id are judged one by one, equal rows alike.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_rows=True)
    return restored(found.where("not contaminated"), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, row by row; a null text counts as empty."""
    return bpe(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_chunks),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: The likelihood ratio, the rolling hashes' 64-bit stages and BPE have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last goes through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
