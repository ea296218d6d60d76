"""Information of tables with optimised columns, and least squares from moments."""

from itertools import combinations

import numpy as np
import pytest

from driftwell.operators import frame


def test_best_columns_is_the_best_of_all_cuts():
    rng = np.random.default_rng(0)
    log = lambda c: float(np.sum(c[c > 0] * np.log(c[c > 0])))
    for _ in range(10):
        t = rng.integers(0, 9, (3, 7)).astype(float)
        got = frame.best_columns(t, 5)
        for k in range(1, 6):
            best = max(
                sum(log(t[:, a:b].sum(1)) - log(t[:, a:b].sum(keepdims=True).ravel()) for a, b in zip((0, *cut), (*cut, 7))) for j in range(1, k + 1) for cut in combinations(range(1, 7), j - 1)
            )
            assert got[k - 1] == pytest.approx(best)


def test_relevance(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 3000)
    rows = [(float(v), float(rng.uniform()), float(v) if i % 2 else None, float(v * v + 0.02 * rng.normal())) for i, v in enumerate(x)] + [(0.1, 0.1, 0.1, None), (float("nan"), 0.5, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)
    got = {r["feature"]: (r["mic"], r["rows"]) for r in frame.relevance(df, ["a", "b", "c"], "y").collect()}
    assert got["a"][0] > 0.85 > 0.25 > got["b"][0] and got["c"][0] > 0.8
    assert got["a"][1] == 3000 and got["b"][1] == 3001 and got["c"][1] == 1501
    assert frame.relevance(df.limit(0), ["a"], "y").count() == 0


def test_no_less_than_even_grids():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=1000)
    for y in (x**3, np.sin(9 * x), rng.uniform(size=1000)):
        fine = lambda v: (np.argsort(np.argsort(v)) * 60 // 1000)
        table = np.zeros((60, 60))
        np.add.at(table, (fine(x), fine(y)), 1)
        assert frame.mic_of_table(table) > frame.mic(x, y) - 0.02


def test_quadratic_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(1000, 1100, 300)
    rows = [("a", float(v), float(3 - 2 * v + 0.5 * v * v + rng.normal())) for v in x] + [("b", 5.0, 1.0), ("b", 7.0, 5.0), ("c", 4.0, 9.0), ("c", 4.0, 11.0), ("c", None, 1.0), ("d", None, 1.0)]
    got = {r["k"]: r for r in frame.quadratic_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    want = np.polyfit(x, [r[2] for r in rows[:300]], 2)
    at = lambda r, v: r["constant"] + (r["linear"] or 0) * v + (r["square"] or 0) * v * v
    assert [at(got["a"], v) for v in (1000, 1050, 1100)] == pytest.approx([np.polyval(want, v) for v in (1000, 1050, 1100)], rel=1e-6)
    assert got["b"]["square"] is None and at(got["b"], 6.0) == pytest.approx(3.0) and got["c"]["linear"] is None and got["c"]["constant"] == pytest.approx(10.0) and "d" not in got
