"""The incremental inbox: each file that arrives is imported once; re-planning is idempotent.

Defined results: a file without a leading time has none; an empty file has no facts but an error row; two files of one name are two
documents if they came at different times; an empty inbox writes nothing; a batch run again writes the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_facts
from ..sources.store import delete_files


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Files named <epoch-ms>_<name>: (file, name, arrived_ms, full_text) as a stream."""
    raw = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(path)
    file = F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))
    return raw.select(
        file.alias("file"), F.regexp_replace(file, r"^\d+_", "").alias("name"), F.regexp_extract(file, r"^(\d+)_", 1).try_cast("long").alias("arrived_ms"), F.regexp_replace("value", "\r\n?", "\n").alias("full_text")
    )


def drain(spark: SparkSession, inbox: str, out: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, delete: bool = False) -> StreamingQuery:
    """Import all that has arrived, then stop. A batch that is run again overwrites its own folder, named by the stream's own id and the
    batch's number, so that each document's facts are written once whatever happens, and a stream begun anew overwrites nothing of
    the one before. Files without readable text give rows in `<out>-errors`. With `delete`, imported files, those too, are removed once
    their batch is written; one that is gone already is no error."""

    def put(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
        own = f"stream={stream}/batch={number}"
        docs = batch.withColumn("doc_id", F.xxhash64("name", "arrived_ms"))
        bad = ~F.coalesce("full_text", F.lit("")).rlike(r"\S")
        broken = F.contains("full_text", F.lit("\ufffd"))
        errors = docs.where(bad | broken).select("doc_id", "file", F.when(bad, "no text").otherwise("not UTF-8").alias("error"))
        errors.write.mode("overwrite").parquet(f"{out}-errors/{own}")
        facts = extract_facts(docs.where(~bad)).join(docs.select("doc_id", "name"), "doc_id")
        facts.write.mode("overwrite").parquet(f"{out}/{own}")
        if after:
            after(facts, number)
        if delete:
            delete_files(batch.select(F.col("file").alias("name")), inbox if ":" in inbox else f"file://{inbox}").write.format("noop").mode("overwrite").save()

    query = arrivals(spark, inbox).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
