"""Whitening against a dense eigenvalue decomposition, and exact deviations."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from panelgate.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int, component int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v, 1, 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)) + wh.OFFSET
    c = x - x.mean(axis=0)
    values, found = np.linalg.eigh(c.T @ c / len(x))
    whole = x.astype(np.int64).astype(object)
    deviations = ((whole * len(x) - whole.sum(axis=0)) ** 2).sum(axis=1)
    return c, values[::-1], found[:, ::-1], deviations


def check(spark, vectors, components=32, rank=None):
    out = wh.whiten(table(spark, vectors), components).toPandas()
    out = out.sort_values(["vec_id", "component"])
    c, values, found, deviations = expected(vectors)
    k = min(components, rank or c.shape[1])
    n = len(c)
    assert len(out) == n * k
    assert out.component.tolist() == list(range(1, k + 1)) * n
    assert set(out.n) == {n}
    assert out.deviation.tolist() == np.repeat(deviations, k).tolist()
    white = out.whitened.to_numpy().reshape(n, k)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    assert out.identity_error.max() < 1e-9
    share = out.explained.to_numpy().reshape(n, k)[0]
    assert np.allclose(share, values[:k] / values.sum(), rtol=1e-9)
    distinct = np.abs(np.diff(values[: k + 1])).min() > 1e-6 * values[0]
    if distinct:
        other = c @ found[:, :k] / np.sqrt(values[:k])
        sign = np.sign((white * other).sum(axis=0))
        assert np.abs(white * sign - other).max() < 1e-6


@pytest.mark.parametrize("n,d,components", [(300, 12, 32), (500, 40, 32), (200, 20, 5)])
def test_components_equal_a_dense_decomposition(spark, n, d, components):
    dice = np.random.default_rng(n)
    vectors = (dice.standard_normal((n, d)) * np.linspace(3, 0.5, d)).tolist()
    check(spark, vectors, components)


def test_a_third_of_equal_vectors_and_a_lost_dimension(spark):
    dice = np.random.default_rng(3)
    vectors = dice.standard_normal((120, 6))
    vectors[:40] = vectors[0]
    vectors[:, 5] = 2.0
    check(spark, vectors.tolist(), rank=5)


def test_repeated_eigenvalues_are_all_found(spark):
    d = 5
    vectors = np.concatenate([np.eye(d), -np.eye(d)]) * 2
    check(spark, vectors.tolist())


def test_rows_that_cannot_be_used_are_left_out(spark):
    good = [[float(i), float(i * i % 7)] for i in range(9)]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")]]
    ids = [*range(8), 7, *range(100, 105)]
    out = wh.whiten(table(spark, good + bad, ids)).collect()
    assert sorted(r.vec_id for r in out) == sorted([*range(8), 7] * 2)
    without = wh.whiten(table(spark, good, [None] * 9)).collect()
    assert len(without) == 18 and {r.vec_id for r in without} == {None}


def test_nothing_to_whiten(spark):
    assert wh.whiten(table(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert wh.whiten(table(spark, [[1.0, 2.0]])).collect() == []
    assert wh.whiten(table(spark, [None])).collect() == []
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lengths_must_agree(spark):
    with pytest.raises((PySparkException, ValueError), match="different lengths"):
        wh.whiten(table(spark, [[1.0], [1.0, 2.0]])).collect()


def test_large_entries_stay_exact(spark):
    vectors = [[3e6, 1.0], [-2e6, 5.0], [1e5, -3.0], [7.0, 2.0]]
    check(spark, vectors)


def test_whole_numbers_round_down():
    assert wh.whole_numbers(np.array([-0.001, 0.0, 1 / 64, 0.0155, 1e300])).tolist() == [-1, 0, 1, 0, 2**62]


@pytest.mark.parametrize("wanted", [3, 20])
def test_bidiagonalisation_of_a_dense_matrix(wanted):
    dice = np.random.default_rng(8)
    x = dice.standard_normal((80, 20)) * 2.0 ** -np.arange(20)
    passes = []

    def product(h):
        passes.append(1)
        return x.T @ (x @ h), float((x @ h) @ (x @ h))

    values, found = wh.bidiagonalise(product, 20, wanted)
    real = np.linalg.svd(x)[1][:wanted]
    assert np.allclose(values, real, rtol=1e-6)
    assert np.allclose(found.T @ found, np.eye(wanted), atol=1e-12)
    if wanted == 3:
        assert len(passes) < 20
