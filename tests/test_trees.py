"""Boosted trees: exact splits on small tables, losses, missing values, retraining, and Spark ML's error as a measure."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import boost
from driftwell.operators import trees as T


def table(spark, n, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = 3 * np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + noise * rng.normal(size=n)
    rows = [(i, *(None if rng.random() < 0.1 and j == 3 else float(v) for j, v in enumerate(r)), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y double").repartition(3).cache()


FS = ["a", "b", "c", "d"]


def error(model, df):
    return boost.predict_regression(model, df, model.features).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]


def test_as_good_as_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    train, held = table(spark, 2500), table(spark, 1500, seed=1)
    ours = T.fit(train, FS, "y", p=T.Parameters(trees=20, depth=4, eta=0.3))
    prepare = lambda df: VectorAssembler(inputCols=FS, outputCol="f").transform(df.fillna(-1e30))
    theirs = GBTRegressor(featuresCol="f", labelCol="y", maxIter=20, maxDepth=4, stepSize=0.3, maxBins=64).fit(prepare(train))
    ml = theirs.transform(prepare(held)).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert error(ours, held) < 1.05 * ml


def best_split(x, y, lam):
    """The exhaustive best first split of squared error, missing values on either side."""
    g, best = y.mean() - y, (0.0, None)
    score = lambda s: g[s].sum() ** 2 / (s.sum() + lam)
    for f in range(x.shape[1]):
        for t in np.unique(x[~np.isnan(x[:, f]), f]):
            for m in (True, False):
                left = np.where(np.isnan(x[:, f]), m, x[:, f] <= t)
                if left.any() and not left.all():
                    gain = (score(left) + score(~left) - score(np.ones(len(y), bool))) / 2
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, t))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_first_split_is_the_best(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (40, 3)).astype(float)
    x[rng.random((40, 3)) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 0], nan=20) + rng.normal(size=40)
    df = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    tree = T.fit(df, ["a", "b", "c"], "y", p=T.Parameters(trees=1, depth=1)).trees[0]
    gain, (f, _) = best_split(x, y, 1.0)
    assert tree["feature"][0] == f and tree["gain"][0] == pytest.approx(gain)
    assert tree["cover"][0] == 40 and tree["cover"][1] + tree["cover"][2] == 40


def test_huber_bears_outliers(spark):
    df = table(spark, 800, noise=0.1).withColumn("y", F.when(F.col("k") % 20 == 0, 500.0).otherwise(F.col("y")))
    clean, p = df.where("k % 20 <> 0"), T.Parameters(trees=15, depth=3, eta=0.4)
    assert error(T.fit(df, FS, "y", "huber", 1.0, p), clean) < 0.2 * error(T.fit(df, FS, "y", "mse", 1.0, p), clean)


def test_gradients_are_derivatives():
    rng = np.random.default_rng(2)
    for loss, k in (("mse", 1), ("huber", 1), ("logistic", 1), ("multinomial", 4)):
        m = rng.normal(size=(30, k))
        y = rng.integers(0, max(k, 2), 30).astype(float)
        g, h = T.gradients(loss, 0.7, m, y)
        for j in range(k):
            e = np.zeros((1, k))
            e[0, j] = 1e-5
            up, at, down = (T.losses(loss, 0.7, m + s * e, y) * (0.5 if loss == "mse" else 1) for s in (1, 0, -1))
            assert np.allclose((up - down) / 2e-5, g[:, j], atol=1e-6)
            assert loss == "huber" or np.allclose((up - 2 * at + down) / 1e-10, h[:, j], atol=1e-3)


def test_several_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 3, (600, 2))
    df = spark.createDataFrame([(i, *map(float, r), "abc"[int(r[0])] if r[1] > 0.5 else "d") for i, r in enumerate(x)] + [(-1, 1.0, 1.0, None)], "k long, a double, b double, c string")
    model, classes = boost.train_classification(df, ["a", "b"], "c", trees=6, depth=3)
    assert classes == ["a", "b", "c", "d"] and model.loss == "multinomial" and len(model.trees) == 24
    out = boost.predict_classification(model, classes, df, ["a", "b"], top=4).collect()
    assert np.mean([r["prediction"] == r["c"] for r in out if r["k"] >= 0]) > 0.97
    assert all(sum(t["class_probability"] for t in r["top_classes"]) == pytest.approx(1) for r in out)


def test_retraining_changes_only_the_chosen_trees(spark):
    old, new = table(spark, 800), table(spark, 800, seed=5).withColumn("y", F.col("y") + F.when(F.col("a") > 1, 4.0).otherwise(0.0))
    p = T.Parameters(trees=8, depth=3, eta=0.4)
    model = T.read_model(T.fit(old, FS, "y", p=p).to_json())
    again = T.retrain(model, new, "y", [2, 5, 7], p)
    assert [i for i, (a, b) in enumerate(zip(model.trees, again.trees)) if a != b] == [2, 5, 7]
    assert error(again, new) < 0.8 * error(model, new)
    # a change costs: the dearer, the nearer the new margins stay to the old
    far = T.retrain(model, new, "y", [2, 5, 7], p, keep=50.0)
    near = lambda m: T.predict(m, T.predict(model, new, "o"), "n").agg(F.avg((F.col("n")[0] - F.col("o")[0]) ** 2)).first()[0]
    assert near(far) < near(again)


def test_least_useful_trees(spark):
    df = table(spark, 500)
    model = T.fit(df, FS, "y", p=T.Parameters(trees=4, depth=3))
    idle = dict(model.trees[1], value=[0.0] * len(model.trees[1]["value"]))
    model = T.replace_trees(model, {1: idle})
    whole, each = T.loss_without(model, df, "y")
    assert each[1] == pytest.approx(whole) and min(e for i, e in enumerate(each) if i != 1) > whole
    assert T.retrain(model, df, "y", 1, T.Parameters(depth=3)).trees[1] != idle


def test_regularisation_and_sampling(spark):
    df = table(spark, 600)
    leaves = lambda m: sum(f < 0 for t in m.trees for f in t["feature"])
    free = T.fit(df, FS, "y", p=T.Parameters(trees=3, depth=5))
    assert leaves(T.fit(df, FS, "y", p=T.Parameters(trees=3, depth=5, tree_size=20.0))) < leaves(free)
    soft = T.fit(df, FS, "y", p=T.Parameters(trees=3, depth=5, depth_cost=1.0, soft_depth=2.0, soft_width=0.2))
    assert leaves(soft) < leaves(free)
    some = T.fit(df, FS, "y", p=T.Parameters(trees=3, depth=3, sample=0.5, bag=0.5, rewrite=2))
    assert all(200 < t["cover"][0] < 400 for t in some.trees) and all(len({f for f in t["feature"] if f >= 0}) <= 2 for t in some.trees)
    assert T.fit(df, FS, "y", p=T.Parameters(trees=3, depth=3, rewrite=1)).trees[2]["value"] == pytest.approx(T.fit(df, FS, "y", p=T.Parameters(trees=3, depth=3)).trees[2]["value"])


def test_odd_tables(spark):
    schema = "a double, y double"
    with pytest.raises(ValueError):
        T.fit(spark.createDataFrame([], schema), ["a"], "y")
    with pytest.raises(ValueError):
        T.fit(spark.createDataFrame([(1.0, None)], schema), ["a"], "y")
    one = T.fit(spark.createDataFrame([(None, 5.0), (None, 5.0)], schema), ["a"], "y", p=T.Parameters(trees=2))
    assert boost.predict_regression(one, spark.createDataFrame([(1.0, 0.0), (None, 0.0)], schema), ["a"]).agg(F.avg("prediction")).first()[0] == 5.0
    for text in ("", "{}", "[]", json.dumps(json.loads(one.to_json()) | {"loss": "other"}), json.dumps(json.loads(one.to_json()) | {"trees": [{"feature": [0]}]})):
        with pytest.raises(ValueError):
            T.read_model(text)
