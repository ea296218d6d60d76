"""Bayesian search against a grid of as many trials."""

import math

import numpy as np
import pytest

from driftwell.operators import trees as T
from driftwell.operators import tuning as B

PLANE = {"a": B.Range(-2, 2), "b": B.Range(0.01, 100, log=True)}


def valley(p):
    u, v = p["a"] - 0.37, math.log10(p["b"]) + 0.61
    return u * u + 2 * (v - 0.3 * u) ** 2


@pytest.mark.parametrize("seed", range(4))
def test_beats_the_grid(seed):
    best, value, found = B.search(valley, PLANE, trials=25, seed=seed)
    grid = min(valley({"a": PLANE["a"].at(i / 4), "b": PLANE["b"].at(j / 4)}) for i in range(5) for j in range(5))
    assert len(found) == 25 and value == valley(best) < grid / 4


def test_ranges():
    assert B.Range(2, 7, whole=True).at(0.999) == 7 and B.Range(2, 7, whole=True).at(0.0) == 2 and B.Range(1, 100, log=True).at(0.5) == pytest.approx(10)


def test_failed_trials_are_avoided():
    best, value, _ = B.search(lambda p: math.nan if p["a"] > 0 else (p["a"] + 1) ** 2, {"a": B.Range(-2, 2)}, trials=15)
    assert best["a"] <= 0 and value < 0.05


def test_process_goes_through_its_points():
    rng = np.random.default_rng(0)
    x = rng.random((12, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1]
    m, s = B.Process(x, y).foretold(x)
    assert np.abs(m - y).max() < 0.05 and s.max() < 0.2


def test_tune(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(math.sin(4 * a) + 0.1 * rng.normal())) for i, a in enumerate(rng.uniform(-1, 1, 200))]
    df = spark.createDataFrame(rows, "k long, a double, y double").coalesce(2)
    space = {"eta": B.Range(0.01, 0.5, log=True), "depth": B.Range(1, 3, whole=True)}
    model, p, found = B.tune(df, ["a"], "y", "k", space=space, trials=3, folds=2, fixed=T.Parameters(trees=3))
    assert len(found) == 3 and p.eta == min(found, key=lambda f: f[1])[0]["eta"] and len(model.trees) == 3
