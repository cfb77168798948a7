"""Embedding whitening: leading components of quantised vectors by matrix-free block Lanczos.

The covariance V is never formed. Each step sends a block of directions to the tasks, which centre their vectors and
return the sum of x (x . q) over them; the sums meet in a shuffle keyed by dimension, so that the driver sees one
block (dimensions x block width) a step. New blocks are orthogonalised against the whole basis, twice. Directions that
break down are replaced by random ones (fixed seed), orthogonal to the basis. The walk ends when the residuals
|V y - e y| of the wanted components are below TOLERANCE times the largest eigenvalue, or when the basis spans all dimensions.

Defined results: vectors that are null or hold null or non-finite entries are dropped; of vectors of unequal lengths the
shorter ones count as zero in the dimensions that they lack; equal vectors are fitted once and each of their rows is returned, rows
with a null vec_id too; components of tied eigenvalues are any orthonormal basis of their space; components of
eigenvalue zero (fewer distinct vectors or dimensions than components) aren't returned; an empty table gives no rows.
A deviation too large for a long is null in `deviation` and whole in `deviation_exact`; sums that don't fit 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches, table

COMPONENTS, UNIT = 4, 256
#: Directions of one pass over the vectors; residuals relative to the largest eigenvalue; what counts as eigenvalue zero.
BLOCK, TOLERANCE, ZERO = 16, 1e-13, 1e-12
SEED = 20
WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "eigenvalue double, deviation_exact decimal(38,0)"
)


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x, the entries in whole units, of the vectors without null or non-finite entries."""
    c = F.col(vec_col).cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(v * F.lit(float(UNIT))))
    return rows.where(c.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows of d whole numbers, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if (lengths == d).all():
        return values.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = values
    return out


def summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
    """The sum of part(vectors), a matrix of `width` columns, over all batches of the fit list."""
    names = [f"c{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix(batch.column(0), d))
                total = found if total is None else total + found
        if total is not None:
            columns = [pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", *names])

    parts = fit.select("x").mapInArrow(sums, ", ".join(["i int", *(f"{c} {kind}" for c in names)]))
    found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect()  # a row a dimension
    return np.array([[r[c] for c in names] for r in sorted(found, key=lambda r: r["i"])])


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V q, by one pass over the fit list."""

    def part(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ q)

    return summed(fit, len(mean), part, q.shape[1]) / n


def fresh(block: np.ndarray, basis: np.ndarray, width: int, floor: float, rng: np.random.Generator) -> np.ndarray:
    """Up to `width` orthonormal directions of the block, orthogonal to the basis; random ones where it breaks down (shorter than floor)."""
    found = np.zeros((len(basis), 0))
    block = block - basis @ (basis.T @ block)
    norms = np.linalg.norm(block, axis=0)
    queue = [block[:, i] for i in np.argsort(-norms)]
    while found.shape[1] < width:
        v = queue.pop(0) if queue else None
        least = floor
        if v is None:
            v, least = rng.standard_normal(len(basis)), 1e-8
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            v = v - found @ (found.T @ v)
        size = np.linalg.norm(v)
        if size > least:
            v = v / size
            v = v - basis @ (basis.T @ v)
            v = v - found @ (found.T @ v)
            found = np.column_stack([found, v / np.linalg.norm(v)])
    return found


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, falling, their unit eigenvectors as columns, and how many blocks were multiplied."""
    rng = np.random.default_rng(SEED)
    basis = image = np.zeros((d, 0))
    following = fresh(np.zeros((d, 0)), basis, min(block, d), 0.0, rng)
    passes = 0
    while True:
        basis, image = np.column_stack([basis, following]), np.column_stack([image, times(following)])
        passes += 1
        inner = basis.T @ image
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        top = max(abs(values[0]), np.finfo(float).tiny)
        left = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        # a second block at least: the first may be invariant by chance and miss a larger eigenvalue
        if basis.shape[1] == d or (passes > 1 and (left <= tolerance * top).all()):
            found = basis @ vectors
            return values, found / np.linalg.norm(found, axis=0), passes
        newest = image[:, -following.shape[1] :]
        following = fresh(newest, basis, min(block, d - basis.shape[1]), tolerance * top, rng)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per vector the sum over dimensions of (n x - S)^2, exactly."""
    largest = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if x.shape[1] * largest**2 < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    wide = x.astype(object) * n - sums.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def placed(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float, error: float) -> Iterator[pa.RecordBatch]:
    k, names = len(values), [c.split()[0] for c in WHITENED.split(", ")]
    for batch in batches:
        x, rows = matrix(batch.column(1), len(sums)), batch.num_rows
        white = ((x - sums / n) @ vectors) / np.sqrt(values)
        exact = np.repeat(np.array(deviations(x, n, sums), object), k)
        at = pa.array(np.repeat(np.arange(rows), k))
        columns = [
            batch.column(0).take(at),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * k, n)),
            pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
            pa.array(white.reshape(-1)),
            pa.array(np.tile(values / trace, rows)),
            pa.array(np.full(rows * k, error)),
            pa.array(np.tile(values, rows)),
            pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def whitening(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, component, ...) of every vector of rows (vec_id, embedding) and each of its leading components."""
    spark = rows.sparkSession
    small_batches(spark)
    own = quantised(rows)
    fit = saved(own.select("x").distinct(), "distinct-vectors")
    span = F.greatest(F.array_max("x"), -F.greatest(F.coalesce(F.array_min("x"), F.lit(0)), F.lit(1 - (1 << 63))))
    n, d, largest = fit.agg(F.count(F.lit(1)), *(F.coalesce(F.max(c), F.lit(0)) for c in (F.size("x"), span))).first()
    nothing = spark.createDataFrame([], WHITENED)
    if not n or not d:
        return nothing
    if n * largest >= 1 << 62:
        raise OverflowError(f"the sums of {n} vectors with entries of up to {largest / UNIT:g} don't fit 64 bits")
    sums = summed(fit, d, lambda x: x.sum(axis=0)[:, None], 1, "long")[:, 0].astype(np.int64)
    mean = sums / n
    trace = float(summed(fit, d, lambda x: np.array([[sum(deviations(x, n, sums)) / n**2]], float), 1)[0, 0]) / n
    if not trace:
        return nothing
    values, vectors, _ = lanczos(lambda q: covariance_times(fit, mean, n, q), d, min(components, d), block)
    some = values > ZERO * values[0]
    values, vectors = values[some], vectors[:, some]
    scaled = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = np.column_stack([(x - mean) @ scaled, np.ones(len(x))])
        return white.T @ white

    second = summed(fit, d, moments, len(values) + 1) / n
    error = float(np.abs(second[:-1, :-1] - np.outer(second[-1, :-1], second[-1, :-1]) - np.eye(len(values))).max())
    return own.mapInArrow(lambda it: placed(it, n, sums, values, vectors, trace, error), WHITENED)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
