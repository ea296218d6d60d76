"""Op 11 against exact rational arithmetic and numpy's solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from driftwell.llm import whitening


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
@pytest.mark.parametrize("kind", ["random", "low rank", "graded", "equal", "zero", "blocks"])
def test_eigen(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = {
        "random": a + a.T, "low rank": a[:, : n // 2 + 1] @ a[:, : n // 2 + 1].T, "graded": np.diag(10.0 ** -np.arange(n)) + 1e-40 * (a + a.T),
        "equal": 3 * np.eye(n), "zero": np.zeros((n, n)), "blocks": np.kron(np.eye(n), np.array([[2.0, 1.0], [1.0, 2.0]])),
    }[kind]
    values, vectors = whitening.eigen(a)
    size = max(1e-300, np.abs(a).max())
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * n * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * n * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13


def test_products_keep_both_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 5)) * 10.0 ** rng.integers(-8, 9, (700, 5))
    sums = whitening.Products(5)
    sums.take(x, x * 1e-18)
    for i, (high, low) in enumerate(sums.rows):
        for k in range(5 - i):
            exact = sum((Fraction(a) + Fraction(p)) * (Fraction(b) + Fraction(q)) for a, p, b, q in zip(x[:, i], x[:, i] * 1e-18, x[:, i + k], x[:, i + k] * 1e-18))
            size = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(x[:, i], x[:, i + k]))
            assert abs(Fraction(high[k]) + Fraction(low[k]) - exact) <= size * Fraction(2) ** -98


def exact(vectors, components=32):
    """Everything but the eigenvectors in whole numbers and fractions."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    far = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(f[i] * f[j] for f in far), n**3)) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(v)
    keep = [i for i in np.argsort(-values) if values[i] > d * 2.0**-52 * values.max()][:components]
    centred = np.array(far, float) / n
    return n, [sum(a * a for a in f) for f in far], centred @ basis[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(v)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 1, 5, 100, 1, 0.5] + [0, 1e6, -3, 0, 9, 1]).astype(np.float32)
    v[:, 5] = 2.5  # no spread
    return v


def test_whiten(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [None] * 6), (902, [math.nan] + [0.0] * 5), (903, [math.inf] * 6), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, n string, component int").repartition(5)
    got = whitening.whiten(df, "vec_id", "embedding").orderBy("vec_id", "component").collect()
    n, far, white, explained = exact(vectors)
    assert len(got) == n * 5 and {r.vec_id for r in got} == set(range(n)) and {r.n for r in got} == {n}
    assert [int(r.deviation) for r in got[::5]] == far
    w = np.array([r.whitened for r in got]).reshape(n, 5)
    signs = np.sign((w * white).sum(0))
    assert np.abs(w - white * signs).max() < 1e-7
    assert np.allclose([r.explained for r in got[:5]], explained, rtol=1e-9) and [r.component for r in got[:5]] == [1, 2, 3, 4, 5]
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(5)).max() < 1e-9


def test_fewer_components_repeats_and_null_ids(spark, vectors):
    rows = [(None, v.tolist()) for v in vectors[:20]] + [(1, vectors[0].tolist())] * 3
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", components=2).collect()
    assert len(got) == 46 and sum(r.vec_id is None for r in got) == 40 and {r.n for r in got} == {23}
    assert len({r.whitened for r in got if r.vec_id == 1}) == 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_spread(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect() == []


def test_deviations_beyond_64_bits():
    y = np.array([[3 * 10**9, -5], [0, 2]], np.int64)
    assert whitening.deviations(y, 10**6, [7, 1]) == [(3 * 10**15 - 7) ** 2 + (-5 * 10**6 - 1) ** 2, 49 + (2 * 10**6 - 1) ** 2]
