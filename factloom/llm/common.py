"""What the training-data operators share: tables, shared folder, word hashing."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: White space of the contracts: a space, or tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the workers if their path doesn't lead to it already."""
    root = Path(__file__).resolve().parents[2]
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if str(root) in known or os.path.realpath(os.getcwd()) == str(root) or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/factloom", "zip", root, "factloom")
    spark.sparkContext.addPyFile(made)


def small_batches(spark: SparkSession) -> None:
    """Long texts travel in Arrow batches of bounded rows and bytes, unless the session already set smaller ones.

    The settings stay with the session: plans are run after the operator has returned.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where that is unset, a fresh local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie, all in one folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; what was made from them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to a fresh table in the application's part of the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table carries."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed * 2 + 0x9E3779B97F4A7C15))


def mask_of(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and text as `texts_of` gives them, and all other columns in a struct `rest`, safe from clashes."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest)


def restored(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns of the table that was `carried`, and more."""
    return df.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns), *more)


def map_texts(docs: DataFrame, function: Callable, ddl: str, keep_rows: bool) -> DataFrame:
    """Map batches of (doc_id, text) by a function of one batch each; with keep_rows, text and rest stay beside."""
    if not keep_rows:
        return texts_of(docs).mapInArrow(function, ddl)
    rows = carried(docs)
    schema = T.StructType.fromDDL(ddl).add("text", "string").add("rest", rows.schema["rest"].dataType)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in function(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(1), batch.column(2)], names=[*out.schema.names, "text", "rest"])

    return rows.mapInArrow(both, schema)


class Texts:
    """The words of a batch of texts, found and hashed over its raw UTF-8 bytes at once.

    A word is a longest run of bytes that `space` doesn't mark, inside one text. `fold`, if given,
    maps bytes before that. Hashes depend on the words alone, so they agree in every process.
    `first[i]` is the index of text i's first word; first[-1] is the number of words.
    """

    def __init__(self, column: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray | None = None):
        column = column.cast(pa.large_string()).fill_null("")
        if len(column) == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        else:
            _, ends, data = column.buffers()
            offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
            self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            self.offsets = offsets - offsets[0]
        if fold is not None:
            self.data = fold[self.data]
        inside = np.concatenate([[False], ~space[self.data], [False]])
        begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]  # a word never runs on into the next text
        begins[edges] |= inside[edges + 1]
        stops[edges - 1] |= inside[edges]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.inside = inside[1:-1]
        self.known: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word; computed once, in blocks so that temporaries stay small."""
        if seed in self.known:
            return self.known[seed]
        lengths = self.ends - self.starts
        done = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(len(lengths), np.uint64)
        longest = int(lengths.max(initial=0))
        table, powers = _table(seed + 1, 256), np.ones(longest + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(longest, np.uint64(0x9E3779B97F4A7C15 + 2 * seed)))
        at = 0
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(done, done[at] + (1 << 21), "right")) - 1)
            begin = done[at:to] - done[at]
            where = np.arange(done[to] - done[at]) - np.repeat(begin, lengths[at:to])
            codes = self.data[where + np.repeat(self.starts[at:to], lengths[at:to])]
            out[at:to] = np.add.reduceat(table[codes] * powers[where], begin)
            at = to
        self.known[seed] = mix(out + lengths.astype(np.uint64))
        return self.known[seed]

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def words(self, at: int, to: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at:to], self.ends[at:to], strict=True)]

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask (over all bytes) marks."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[self.offsets])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
    for i in range(k):
        out = out * np.uint64(0x100000001B3 + 2 * (seed << 20)) + hashes[i : i + n]
    return mix(out)


def lowest(values: np.ndarray, w: int) -> np.ndarray:
    """Marks each value that is the minimum of at least one window of w values in a row."""
    n = len(values)
    if n < w:
        return np.zeros(n, bool)
    low = values[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, values[i : n - w + 1 + i], out=low)
    out = np.zeros(n, bool)
    for i in range(w):
        out[i : n - w + 1 + i] |= values[i : n - w + 1 + i] == low
    return out
