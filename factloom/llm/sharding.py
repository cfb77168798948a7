"""Sharding by a Hilbert curve over quantised metadata, cut into runs of equal row counts.

Language, source and size are quantised to BITS bits each; a row's place on the curve through that
grid comes first in the order, then a hash of its id. Runs of that order are the shards, so a shard
spans a compact box of the metadata and a reader can skip whole shards by their bounds.

No rows meet in one task to be numbered: a cell of the curve is split by hash into as many parts as
keep a part near PART_ROWS rows, rows are numbered inside their part, and parts are offset by two
running sums, over the parts of a cell and over the (at most 2^(3*BITS)) cells. A cell that holds a
third of all rows is many parts.

Law: `rows` (counts of shards at most one apart). Defined results: a null text has size 16 and the
CRC of the empty text; null metadata is a value of its own; rows that agree in everything, doc_id
included, take neighbouring slots; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 40
BITS = 4
PART_ROWS = 50_000
#: Rows of one file of a shard: no task writes a whole shard.
FILE_ROWS = 500_000


def hilbert_index(coords: list, bits: int):
    """Index along the Hilbert curve of points on a grid of 2^bits a side (array arithmetic)."""
    axes = [c.copy() for c in coords]
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            on = (axes[i] >> level) & 1
            # a set bit flips the low bits of the first axis, a clear one swaps them with this axis
            swap = (axes[0] ^ axes[i]) & low & -(1 - on)
            axes[0] ^= (on * low) ^ swap
            axes[i] ^= swap if i else 0 * swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = axes[0] * 0
    for level in range(bits - 1, 0, -1):
        turn ^= ((axes[n - 1] >> level) & 1) * ((1 << level) - 1)
    index = axes[0] * 0
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | (((axis ^ turn) >> level) & 1)
    return index


def curve() -> np.ndarray:
    """Place on the curve of every cell of the grid, cells numbered by their coordinates, the last fastest."""
    side = np.arange(1 << BITS, dtype=np.int64)
    return hilbert_index([c.reshape(-1) for c in np.meshgrid(side, side, side, indexing="ij")], BITS)


def hilbert(a: str, b: str, c: str) -> Column:
    """Place on the curve of three coordinates: a lookup in an array of literals, inside Catalyst."""
    cell = F.shiftleft(a, 2 * BITS) + F.shiftleft(b, BITS) + F.col(c)
    return F.get(F.lit(curve()), cell.cast("int"))


def category(name: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(1 << BITS))


def quantised(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the three coordinates; columns that are missing count as null."""
    have = set(docs.columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + 16
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        *(category(c).alias(f"at_{c}") if c in have else F.lit(0).cast("long").alias(f"at_{c}") for c in ("lang", "source")),
        F.least(F.greatest(F.floor(F.log2(size)) - 4, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long").alias("at_size"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    total = docs.count()
    parts = max(1, -(-total // PART_ROWS))
    rows = quantised(docs).withColumn("hilbert", hilbert("at_lang", "at_source", "at_size")).withColumn("mark", F.xxhash64("doc_id"))
    rows = rows.withColumn("part", F.pmod(F.shiftright("mark", 8), F.lit(parts)))
    order = Window.partitionBy("hilbert", "part").orderBy("mark", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(order).cast("long") - 1)
    counts = rows.groupBy("hilbert", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("hilbert").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("hilbert", F.coalesce(before, F.lit(0)).alias("cell_at"))
    within = F.sum("n").over(Window.partitionBy("hilbert").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("hilbert", "part", F.coalesce(within, F.lit(0)).alias("part_at")).join(cells, "hilbert")
    rank = F.col("cell_at") + F.col("part_at") + F.col("at")
    out = rows.join(begins, ["hilbert", "part"]).withColumn("rank", rank)
    out = out.withColumn("shard", F.expr(f"(rank * {shards}L) div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert", "at_lang", "at_source", "at_size",
    )


def shard_bounds(placed: DataFrame) -> DataFrame:
    """Per shard the box of its metadata, for pruning."""
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("at_lang", "at_source", "at_size") for f in (F.min, F.max)]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"), *bounds)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs as one folder a shard, files of up to FILE_ROWS rows in curve order, with the shards' bounds beside them.

    Rows that agree in doc_id and text are told apart by number, so that each takes a slot of its own.
    """
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    again = F.row_number().over(Window.partitionBy("_id", "_crc").orderBy("_slot"))
    placed = sharded(docs, shards)
    own = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).withColumn("_n", again)
    keyed = docs.select("*", F.col("doc_id").cast("long").alias("_own"), crc.alias("_own_crc"))
    keyed = keyed.withColumn("_own_n", F.row_number().over(Window.partitionBy("_own", "_own_crc").orderBy(F.lit(0))))
    met = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_crc") == F.col("_crc")) & (F.col("_own_n") == F.col("_n"))
    rows = keyed.join(own, met).select(*(F.col(f"`{c}`") for c in docs.columns), "_shard", "_slot").withColumn("_file", F.expr(f"_slot div {FILE_ROWS}L"))
    rows = rows.repartition("_shard", "_file").sortWithinPartitions("_shard", "_file", "_slot")
    rows.drop("_file").write.mode("overwrite").partitionBy("_shard").parquet(f"{path}/rows")
    shard_bounds(placed).write.mode("overwrite").parquet(f"{path}/bounds")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
