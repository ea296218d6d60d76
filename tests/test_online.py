"""Cluster features, seasonal components with moved buckets, normal models of many variables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions.special import f_right_tail
from driftwell.operators import models, online, seasons


def blobs(spark, n=3000, k=6, d=3, parts=5, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-20, 20, (k, d))
    x = centres[np.arange(n) % k] + rng.normal(0, 1, (n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(parts)


def test_features_add_up_in_any_order(spark):
    x, df = blobs(spark)
    for one in (online.features_of(df, "v", 64), online.features_of(df.orderBy(F.desc("k")).repartition(2), "v", 64)):
        n, s, q = online.taken(one)
        assert len(n) <= 64 and n.sum() == 3000 and np.allclose(s.sum(0), x.sum(0)) and q.sum() == pytest.approx((x * x).sum())
    a, b = (online.features_of(df.where(F.col("k") % 2 == r), "v", 64) for r in (0, 1))
    for one in (online.merged(a, b, most=64), online.merged(b, a, most=64)):
        n, s, _ = online.taken(one)
        assert n.sum() == 3000 and np.allclose(s.sum(0), x.sum(0))


def test_nearly_as_good_as_k_means(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x, df = blobs(spark, k=7)
    centres = online.k_centres(online.features_of(df, "v", 128), 7)
    ml = KMeans(k=7, seed=1, maxIter=30, initSteps=5).fit(df.select(array_to_vector("v").alias("features")))
    assert online.squared(x, centres).min(1).sum() < 1.1 * ml.summary.trainingCost
    labels = {r["key"]: r["cluster"] for r in online.nearest_centre(df, "k", "v", centres).collect()}
    assert len(labels) == 3000 and all(len({labels[i] for i in range(c, 3000, 7)}) == 1 for c in range(7))


def test_number_of_clusters(spark):
    assert len(online.x_centres(online.features_of(blobs(spark, k=5)[1], "v", 128), 9)) == 5


def test_bootstrap_finds_what_k_means_does_not(spark):
    rng = np.random.default_rng(2)
    a, r = rng.uniform(0, 2 * np.pi, 2000), np.where(np.arange(2000) % 2, 10.0, 2.0)
    x = np.stack([r * np.cos(a), r * np.sin(a)], axis=1) + rng.normal(0, 0.15, (2000, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    labels = {c["key"]: c["cluster"] for c in online.bootstrap_clusters(df, "k", "v", 10, most=128, samples=60).collect()}
    inner, outer = {labels[i] for i in range(0, 2000, 2)}, {labels[i] for i in range(1, 2000, 2)}
    assert len(inner) == 1 == len(outer) and inner != outer
    two = {c["key"]: c["cluster"] for c in online.nearest_centre(df, "k", "v", online.k_centres(online.features_of(df, "v", 128), 2)).collect()}
    assert len({two[i] for i in range(1, 2000, 2)}) == 2


def test_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.0])], "k long, v array<double>")
    assert online.taken(online.features_of(df, "v"))[0].sum() == 2
    assert [r["key"] for r in online.nearest_centre(df, "k", "v", np.array([[0.0, 0.0]])).orderBy("key").collect()] == [1, 7]
    assert online.features_of(df.limit(0), "v").count() == 0 and online.k_centres(online.features_of(df.limit(0), "v"), 3).size == 0


def peak(t):
    return 5 + 2 * np.sin(2 * np.pi * t / 86400) + 40 * np.exp(-(((t % 86400) - 30_000) ** 2) / (2 * 900**2))


def test_moved_buckets_fit_a_narrow_peak(spark):
    t = np.arange(0, 86400 * 10, 300)
    rng = np.random.default_rng(3)
    rows = [("a", int(u), float(v)) for u, v in zip(t, peak(t) + rng.normal(0, 0.5, len(t)))] + [(None, 0, 7.0), ("a", None, 1.0), ("a", 3, None)]
    df = spark.createDataFrame(rows, "k string, b long, v double").repartition(3)
    got = seasons.seasonal_component(df, ["k"], "b", "v", 86400, buckets=24).toPandas()
    own = got[got["k"] == "a"]
    truth = peak(own["phase"].to_numpy() + 150.0)
    fixed = own.groupby(own["phase"] // 3600)["mean"].transform("mean")
    assert np.mean((own["fitted"] - truth) ** 2) < 0.2 * np.mean((fixed - truth) ** 2)
    assert got[got["k"].isna()]["fitted"].tolist() == [7.0]


def test_spline_goes_through_its_knots_and_closes():
    x, y = np.array([1.0, 4.0, 7.0, 9.5]), np.array([2.0, -1.0, 3.0, 0.5])
    c = seasons.periodic_spline(x, y, 12.0)
    at = lambda v: seasons.spline_at(x, y, c, 12.0, np.array(v))
    assert np.allclose(at(x), y) and at([0.999999])[0] == pytest.approx(at([1.000001])[0], abs=1e-4)
    slope = lambda u: (at([u + 1e-5]) - at([u - 1e-5]))[0] / 2e-5
    assert slope(4.0 - 1e-4) == pytest.approx(slope(4.0 + 1e-4), abs=1e-2) and slope(0.9999) == pytest.approx(slope(1.0001), abs=1e-2)


def test_normal_model_of_five_variables(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 100
    x[7] = x.mean(0) + 30
    rows = [("a", i, *map(float, v)) for i, v in enumerate(x)] + [("b", i, 1.0, 2.0, 3.0, 4.0, float(i)) for i in range(900, 950)] + [(None, 990, *map(float, x[0])), ("a", 991, None, *map(float, x[0][1:]))]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double, c double, d double, e double").repartition(4)
    got = {r["k"]: r["probability"] for r in models.vector_probabilities(df, ["g"], ["a", "b", "c", "d", "e"]).collect()}
    n, m, s = len(x), x.mean(0), np.cov(x.T, bias=True) * len(x)
    for i in range(0, 400, 7):
        far = (x[i] - m) @ np.linalg.solve(s, x[i] - m) * n / (n + 1)
        assert got[i] == pytest.approx(f_right_tail(far * (n - 5) / 5, 5, n - 5), rel=1e-6)
    assert min(got, key=got.get) == 7 and got[900] == 1.0 == got[990] and 991 not in got


def test_two_variables_as_in_closed_form(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("ab"[i % 2], i, *map(float, v)) for i, v in enumerate(rng.normal(size=(200, 2)))], "g string, k long, x double, y double")
    a = {r["k"]: r["probability"] for r in models.vector_probabilities(df, ["g"], ["x", "y"]).collect()}
    b = {r["k"]: r["probability"] for r in models.pair_probabilities(df, ["g"], "x", "y").collect()}
    assert a == pytest.approx(b, rel=1e-9)
