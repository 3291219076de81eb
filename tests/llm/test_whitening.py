"""Whitening against exact integers and numpy's eigenvectors."""

import math

import numpy as np
import pytest

from siltstone.llm import whitening

TABLE = "vec_id long, embedding array<float>, label int, v string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], TABLE)


def brute(vectors, k):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept))]
    deviations = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept)
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in kept])
    return deviations, y, np.linalg.eigh(y.T @ y / n)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((700, 40)) * np.linspace(3, 0.2, 40))]
    vectors += [(5, vectors[5][1]), (900, [0.0] * 40), (901, vectors[7][1])]
    odd = [(None, [1.0] * 40), (1000, None), (1001, [None] + [1.0] * 39), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (1004, [1.0] * 39), (1005, [])]
    got = whitening.whiten(table(spark, vectors + odd)).collect()
    deviations, y, (values, unit) = brute(vectors, 32)
    assert sorted({(r.vec_id, r.deviation) for r in got}) == sorted(set(deviations)) and all(r.deviation_exact == r.deviation for r in got)
    assert len(got) == 32 * len(vectors) and {r.n for r in got} == {len(vectors)}
    explained = [next(r.explained for r in got if r.component == k) for k in range(1, 33)]
    assert np.allclose(explained, values[::-1][:32] / values.sum(), rtol=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    for k in (1, 2, 17, 32):
        want = y @ unit[:, -k] / np.sqrt(values[-k])
        by = {r.vec_id: r.whitened for r in got if r.component == k}
        ids = [i for i, _ in vectors]
        have = np.array([by[i] for i in ids])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-9)


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_scale(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_dependent_dimensions_and_large_numbers(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [a, a, 5.0, b * 1e30]) for i, (a, b) in enumerate(rng.standard_normal((50, 2)).tolist())]
    got = whitening.whiten(table(spark, vectors)).collect()
    assert {r.deviation for r in got} == {None}  # they pass 64 bits
    small = whitening.whiten(table(spark, [(i, v[:3]) for i, v in vectors])).collect()
    assert {r.component for r in small} == {1}  # a twin and a constant add nothing
    assert abs(np.mean([r.whitened**2 for r in small]) - 1) < 1e-12


@pytest.mark.parametrize("kind", ["plain", "equal", "rank one", "near identity", "blocks"])
def test_components(kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 70))
    a = {"plain": x @ x.T, "equal": np.diag([5.0] * 30 + [1.0] * 30), "rank one": np.outer(x[:, 0], x[:, 0]), "near identity": np.eye(60) + 1e-13 * (x[:, :60] + x[:, :60].T), "blocks": np.kron(np.eye(6), x[:10] @ x[:10].T)}[kind]
    values, unit = whitening.leading_components(a, 32)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:32], atol=1e-13 * np.abs(a).max() * 60)
    assert np.abs(unit.T @ unit - np.eye(32)).max() < 1e-13 and np.abs(a @ unit - unit * values).max() < 1e-12 * np.abs(a).max() * 60
