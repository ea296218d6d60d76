"""Models of two variables and of constants, parts of the week, variance that a season explains, data summaries."""

import json

import numpy as np
import pytest

from driftwell.operators import models, windows
from driftwell.sources import writers


def test_pairs_against_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([3, -2], [[2, 1.5], [1.5, 3]], 400)
    rows = [(None if i % 2 else "a", i, float(u), float(v)) for i, (u, v) in enumerate(x)] + [("a", 900, None, 1.0), ("few", 901, 1.0, 2.0), ("few", 902, 1.0, 3.0)]
    df = spark.createDataFrame(rows + [("line", 910 + i, float(i), 2.0 * i) for i in range(5)], "k string, i int, x double, y double")
    got = {r["i"]: r["probability"] for r in models.pair_probabilities(df, ["k"], "x", "y").collect()}
    assert len(got) == 407 and 900 not in got
    for part in (0, 1):
        v = x[part::2]
        n, centre = len(v), v.mean(0)
        inverse = np.linalg.inv((v - centre).T @ (v - centre))
        for i, row in enumerate(v):
            q = (row - centre) @ inverse @ (row - centre) * n / (n + 1)
            assert got[2 * i + part] == pytest.approx((1 + q) ** (-(n - 2) / 2))
    assert abs(np.mean([got[i] for i in range(400)]) - 0.5) < 0.05  # the chances of draws from the law are even
    assert {got[i] for i in range(901, 903)} | {got[i] for i in range(910, 915)} == {1.0}
    assert models.pair_probabilities(df.where("false"), ["k"], "x", "y").count() == 0


def test_constants(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 6.0), ("b", 1, None), ("b", 2, 7.0), (None, 1, 1.0)], "k string, t int, v double")
    got = {(r["k"], r["t"]): (r["constant"], r["probability"]) for r in models.constant_scores(df, ["k"], ["t"], "v").collect()}
    assert got == {("a", 1): (5.0, 1.0), ("a", 2): (5.0, 1.0), ("a", 3): (5.0, models.LEAST), ("b", 2): (7.0, 1.0), (None, 1): (1.0, 1.0)}


def test_season_and_week(spark):
    hours = np.arange(24 * 28) * 3600 + 1704067200  # a Monday
    weekend = (hours // 86400 + 3) % 7 >= 5
    rng = np.random.default_rng(2)
    y = np.where(weekend, 5.0, 10 + 3 * np.sin(hours / 86400 * 2 * np.pi)) + rng.normal(0, 0.1, len(hours))
    df = spark.createDataFrame([("s", int(t), float(v)) for t, v in zip(hours, y)] + [("one", 0, 1.0), ("s", 0, None)], "k string, t long, y double")
    got = {(r["k"], r["weekend"], r["phase"]): (r["mean"], r["count"]) for r in windows.week_part_means(df.where("k = 's' AND y IS NOT NULL"), ["k"], "t", "y", 86400).collect()}
    assert len(got) == 48 and got["s", True, 3600][1] == 8 and got["s", False, 3600][1] == 20
    assert all(abs(m - 5) < 0.2 for (_, w, _), (m, _) in got.items() if w)
    r = {r["k"]: r for r in windows.seasonal_variance(df, ["k"], "t", "y", 86400).collect()}
    table = y.reshape(-1, 24)
    left = ((table - table.mean(0)) ** 2).sum()
    all_of = ((y - y.mean()) ** 2).sum()
    assert r["s"]["variance"] == pytest.approx(all_of / len(y)) and r["s"]["residual_variance"] == pytest.approx(left / len(y))
    assert r["s"]["f"] == pytest.approx((all_of - left) / 23 / (left / (len(y) - 24)))
    assert (r["one"]["rows"], r["one"]["variance"], r["one"]["f"]) == (1, 0.0, None)


def test_data_summary(spark):
    df = spark.createDataFrame([(1, 'a"b'), (None, None)], "n int, s string")
    docs = [json.loads(r["document"]) for r in writers.data_summary(df, ["n", "s"], ["s"]).collect()]
    assert docs[0] == {"num_columns": 2, "column_names": ["n", "s"], "column_is_categorical": [False, True]}
    assert [d["data"] for d in docs[1:]] == [["1", 'a"b'], [None, None]]
