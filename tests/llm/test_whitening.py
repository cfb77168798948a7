"""Whitening against a dense eigendecomposition of all distinct vectors."""

import math

import numpy as np
import pytest

from factloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n long, x string"


def whole(vectors, d):
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    return np.array([v + [0] * (d - len(v)) for v in x], np.int64)


def check(spark, vectors, k=4, block=W.BLOCK):
    rows = spark.createDataFrame([(i, v, 3, "a") for i, v in enumerate(vectors)], SCHEMA)
    found = W.whitening(rows, k, block).collect()
    good = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(vectors[i]) for i in good)
    x = whole([vectors[i] for i in good], d)
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    v = (fit - mean).T @ (fit - mean) / n
    e, y = np.linalg.eigh(v)
    e, y = e[::-1], y[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, c) for i in good for c in range(1, k + 1))
    got = np.array([[r.whitened for r in found if r.component == c + 1] for c in range(k)])
    ids = [r.vec_id for r in found if r.component == 1]
    at = {i: j for j, i in enumerate(good)}
    for c in range(k):
        want = ((x - mean) @ y[:, c] / np.sqrt(e[c]))[[at[i] for i in ids]]
        assert min(np.abs(got[c] - want).max(), np.abs(got[c] + want).max()) < 1e-8
    for r in found:
        dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at[r.vec_id]], fit.sum(axis=0), strict=True))
        assert r.n == n and int(r.deviation_exact) == dev and r.deviation == dev
        assert abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9 and r.identity_error < 1e-9


def test_equals_dense(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((300, 24)) * np.linspace(1, 0.2, 24)).tolist()
    x += [x[0]] * 200 + [x[5]] * 3 + [None, [None] + x[1][1:], [math.nan] + x[1][1:], [math.inf] + x[1][1:], [-0.0] * 24, [0.0] * 24]
    check(spark, x)
    check(spark, x, k=7, block=3)


def test_low_rank_few_and_ragged(spark):
    rng = np.random.default_rng(2)
    check(spark, (rng.standard_normal((50, 1)) * [[1.0, 2.0, -1.0, 0.5, 0.0, 0.0]]).tolist() + [[1.0]], k=2)
    check(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 7.0]])
    check(spark, [[1.0], [2.0], [5.0], [], [2.0, 3.0]])


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None, 0, "")], [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], [(1, [], 0, "")]):
        assert W.whitening(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_large_sums(spark):
    assert W.deviations(np.array([[1 << 30, -5]]), 1 << 20, np.array([7, 9])) == [((1 << 50) - 7) ** 2 + (5 * (1 << 20) + 9) ** 2]
    rows = [(1, [1e6, 0.0], 0, ""), (2, [0.0, 3e6], 0, ""), (3, [5e7, 7e7], 0, "")]
    assert all(r.deviation == int(r.deviation_exact) if r.deviation_exact < 1 << 63 else r.deviation is None for r in W.whitening(spark.createDataFrame(rows, SCHEMA)).collect())
    with pytest.raises(OverflowError):
        W.whitening(spark.createDataFrame([(1, [1e30], 0, ""), (2, [0.0], 0, "")], SCHEMA))


def dense(spectrum, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(spectrum), len(spectrum))))
    return (q * spectrum) @ q.T


@pytest.mark.parametrize("spectrum", [np.geomspace(1, 1e-6, 120), np.ones(40), np.r_[3, 3, 3, np.zeros(60)], np.r_[np.ones(30) * 2, np.ones(30)], np.linspace(1, 0.99, 90)])
def test_lanczos_spectra(spectrum):
    v = dense(spectrum)
    values, vectors, passes = W.lanczos(lambda q: v @ q, len(v), 4, block=6)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert passes <= math.ceil(len(v) / 6)


def test_decaying_spectrum_needs_few_passes():
    v = dense(np.geomspace(1, 1e-12, 400))
    assert W.lanczos(lambda q: v @ q, 400, 4)[2] <= 12  # of 25 that span all dimensions
