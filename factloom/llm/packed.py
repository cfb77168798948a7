"""Columns of numbers moved through a shuffle as packed arrays, many values to a row.

A row is (bucket, one binary per field). A task flushes what it has gathered split by bucket, so the
shuffle moves a few rows per task and bucket instead of one per value, and no value is boxed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Fields = dict[str, str]


def schema(fields: Fields) -> str:
    return "bucket int, " + ", ".join(f"{name} binary" for name in fields)


def split(bucket: np.ndarray, columns: dict[str, np.ndarray], fields: Fields) -> pa.RecordBatch:
    """One row per bucket that occurs, each field's values in their order of coming; absent fields are empty."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    begins, stops = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(bucket)]]).astype(int)
    if not len(bucket):
        begins = stops = np.zeros(0, int)
    arrays = [pa.array(bucket[begins].astype(np.int32))]
    for name, kind in fields.items():
        if name not in columns:
            arrays.append(pa.array([b""] * len(begins), pa.binary()))
            continue
        own = np.ascontiguousarray(columns[name][order]).astype(kind)
        arrays.append(pa.array([own[a:b].tobytes() for a, b in zip(begins, stops, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *fields])


def joined(batches: Iterator[pa.RecordBatch], fields: Fields) -> dict[str, np.ndarray]:
    """All values of a partition, by field."""
    parts: dict[str, list[bytes]] = {name: [] for name in fields}
    for batch in batches:
        for name in fields:
            parts[name].extend(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return {name: np.frombuffer(b"".join(x), kind) for (name, kind), x in zip(fields.items(), parts.values(), strict=True)}


def by_bucket(batches: Iterator[pa.RecordBatch], fields: Fields) -> Iterator[dict[str, np.ndarray]]:
    """All values of each bucket, by field; a partition's rows come sorted by bucket, and one bucket is held at a time."""
    now, parts = None, {name: [] for name in fields}
    for batch in batches:
        buckets = batch.column(0).to_pylist()
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in fields}
        for i, bucket in enumerate(buckets):
            if bucket != now:
                if now is not None:
                    yield {name: np.frombuffer(b"".join(parts[name]), kind) for name, kind in fields.items()}
                now, parts = bucket, {name: [] for name in fields}
            for name in fields:
                parts[name].append(columns[name][i].as_py())
    if now is not None:
        yield {name: np.frombuffer(b"".join(parts[name]), kind) for name, kind in fields.items()}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame) -> DataFrame:
    """The rows of each bucket in one partition."""
    return df.repartition(partitions(df.sparkSession), "bucket")


def grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (first key first), and where each group of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)
