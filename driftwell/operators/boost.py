"""Regression and classification with boosted trees: training, inference, feature importance, class weights.

Trees are grown by operators/trees.py over the whole table, of several classes one a class and round.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import trees as T
from driftwell.operators.trees import goes_left, tree_values


def train_regression(df: DataFrame, features: list[str], target: str, loss: str = "mse", parameter: float = 1.0, trees: int = 20, depth: int = 5, seed: int = 1, **more) -> T.Model:
    """A regression model of the rows that have a target; parameter is the width of the huber loss."""
    return T.fit(df, features, target, loss, parameter, T.Parameters(trees=trees, depth=depth, seed=seed, **more))


def predict_regression(model: T.Model, df: DataFrame, features: list[str], loss: str = "mse") -> DataFrame:
    return T.predict(model, df, "_m").withColumn("prediction", F.col("_m")[0]).drop("_m")


def train_classification(df: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 5, seed: int = 1, most_classes: int = 30, **more) -> tuple[T.Model, list]:
    """(model, classes): logistic loss for two classes, multinomial for more."""
    p = T.Parameters(trees=trees, depth=depth, seed=seed, **more)
    few = len(df.where(F.col(target).isNotNull()).select(target).distinct().limit(3).collect()) <= 2
    model = T.fit(df, features, target, "logistic" if few else "multinomial", p=p, most_classes=most_classes)
    return model, model.classes


def predict_classification(model: T.Model, classes: list, df: DataFrame, features: list[str], weights: dict | None = None, top: int = 2) -> DataFrame:
    """df with prediction and top_classes (class, probability, score), scores being weighted probabilities."""
    out = T.predict(model, df, "_m")
    if model.loss == "logistic":
        one = 1 / (1 + F.exp(-F.col("_m")[0]))
        p = [1 - one, one][: len(classes)] if len(classes) == 2 else [F.lit(1.0)] * len(classes)
    else:
        shares = F.transform("_m", lambda v: F.exp(v - F.array_max("_m")))
        total = F.aggregate(shares, F.lit(0.0), lambda s, v: s + v)
        p = [shares[i] / total for i in range(len(classes))]
    entries = F.array(*[F.struct((-x * F.lit(float((weights or {}).get(c, 1.0)))).alias("order"), F.lit(c).alias("class"), x.alias("probability")) for c, x in zip(classes, p)])
    ranked = F.transform(F.slice(F.array_sort(entries), 1, top), lambda e: F.struct(e["class"].alias("class_name"), e["probability"].alias("class_probability"), (-e["order"]).alias("class_score")))
    return out.withColumn("top_classes", ranked).withColumn("prediction", F.col("top_classes")[0]["class_name"]).drop("_m")


def class_weights(scored: DataFrame, target: str, probability: str, grid: int = 99) -> tuple[float, float]:
    """(threshold, least recall) that makes the smaller of two classes' recalls largest; one pass over `grid` bins."""
    b = F.least(F.lit(grid), F.floor(F.col(probability) * (grid + 1))).cast("int")
    rows = scored.groupBy(b.alias("bin")).agg(F.count_if(F.col(target) == 1).alias("ones"), F.count_if(F.col(target) == 0).alias("zeros")).toPandas()
    ones, zeros = np.zeros(grid + 1), np.zeros(grid + 1)
    ones[rows["bin"]], zeros[rows["bin"]] = rows["ones"], rows["zeros"]
    recall1 = 1 - np.concatenate([[0], np.cumsum(ones)])[:-1] / max(ones.sum(), 1)
    recall0 = np.concatenate([[0], np.cumsum(zeros)])[:-1] / max(zeros.sum(), 1)
    at = int(np.argmax(np.minimum(recall1, recall0)))
    return at / (grid + 1), float(min(recall1[at], recall0[at]))


def export_trees(model: T.Model) -> list[dict]:
    """Each tree as arrays: feature (-1 at leaves), threshold, missing_left, left, right, value, cover."""
    return model.trees


def conditional_value(tree: dict, x: np.ndarray, known: set[int], at: int = 0) -> np.ndarray:
    """Expected value with only some features known: unknown splits weigh both sides by cover."""
    f = tree["feature"][at]
    if f < 0:
        return np.full(len(x), tree["value"][at])
    l, r = tree["left"][at], tree["right"][at]
    a, b = conditional_value(tree, x, known, l), conditional_value(tree, x, known, r)
    if f in known:
        return np.where(goes_left(tree, at, x[:, f]), a, b)
    share = tree["cover"][l] / max(tree["cover"][at], 1)
    return share * a + (1 - share) * b


def shapley(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """(rows, features) exact path-dependent Shapley values.

    A tree's features are few (at most 2**depth - 1), so the sum over subsets of the features a path meets is
    taken leaf by leaf: a leaf's value is shared out by the products of its path's one-hot and cover fractions.
    """
    out = np.zeros(x.shape)
    for tree in trees:
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            f = tree["feature"][at]
            if f >= 0:
                for child, below in ((tree["left"][at], True), (tree["right"][at], False)):
                    go = goes_left(tree, at, x[:, f]) == below
                    z = tree["cover"][child] / max(tree["cover"][at], 1)
                    o, c = path.get(f, (np.ones(len(x), bool), 1.0))
                    stack.append((child, path | {f: (o & go, c * z)}))
                continue
            names = list(path)
            m = len(names)
            for i in names:
                # polynomial in the number of known others: product of (cover + one * t)
                poly = np.zeros((len(x), m))
                poly[:, 0] = 1
                for d, j in enumerate(n for n in names if n != i):
                    o, c = path[j]
                    grown = poly * c
                    grown[:, 1 : d + 2] += poly[:, : d + 1] * o[:, None]
                    poly = grown
                weight = np.array([1.0])
                fact = np.cumprod([1, *range(1, m + 1)]).astype(float)
                weight = np.array([fact[s] * fact[m - s - 1] / fact[m] for s in range(m)])
                o, c = path[i]
                out[:, i] += tree["value"][at] * (poly @ weight) * (o - c)
    return out


def feature_importance(model: T.Model, df: DataFrame, key: str, features: list[str], output: int = 0) -> DataFrame:
    """(key, baseline, importances): per row, summing to the model's output (of msle, before it is brought to the target's scale)."""
    trees = [t for t in export_trees(model) if t["class"] == output]
    shared = df.sparkSession.sparkContext.broadcast(trees)  # as large as the model
    base = float(model.base[output] + sum(conditional_value(t, np.zeros((1, len(features))), set())[0] for t in trees))

    def run(batches):
        for pdf in batches:
            x = pdf[[f"_f{i}" for i in range(len(features))]].to_numpy(float)
            yield pd.DataFrame({"key": pdf["_k"], "baseline": base, "importances": list(shapley(shared.value, x))})

    rows = df.select(F.col(key).alias("_k"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    return rows.mapInPandas(run, f"key {dict(df.dtypes)[key]}, baseline double, importances array<double>")


def top_importances(df: DataFrame, features: list[str], most: int) -> DataFrame:
    """df with top: the most telling features of each row, with their importance."""
    pairs = F.transform("importances", lambda v, i: F.struct((-F.abs(v)).alias("o"), F.element_at(F.array(*map(F.lit, features)), i + 1).alias("feature"), v.alias("importance")))
    return df.withColumn("top", F.transform(F.slice(F.array_sort(pairs), 1, most), lambda p: F.struct(p["feature"].alias("feature"), p["importance"].alias("importance"))))


def total_importance(importances: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean magnitude over rows."""
    return importances.select(F.posexplode("importances").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("importance")).select(
        F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1).alias("feature"), "importance"
    )


def model_definition(model, features: list[str], kind: str = "regression") -> str:
    """The ensemble as JSON: feature names, trees as node lists, and how leaf values are put together."""
    how = {"logistic_regression": {"weights": [1.0] * (1 + len(model.trees))}} if kind == "classification" else {"weighted_sum": {"weights": [1.0] * (1 + len(model.trees))}}
    trees = [{"tree": {"feature_names": features, "tree_structure": [{"node_index": 0, "leaf_value": model.base[0], "number_samples": 0}], "target_type": kind}}]  # the base
    for t in export_trees(model):
        nodes = [
            {"node_index": i, "leaf_value": t["value"][i], "number_samples": int(t["cover"][i])} if f < 0 else
            {"node_index": i, "split_feature": f, "threshold": t["threshold"][i], "decision_type": "lte", "default_left": bool(t["missing_left"][i]), "left_child": t["left"][i], "right_child": t["right"][i], "number_samples": int(t["cover"][i])}
            for i, f in enumerate(t["feature"])
        ]
        trees.append({"tree": {"feature_names": features, "tree_structure": nodes, "target_type": kind}})
    return json.dumps({"trained_model": {"ensemble": {"feature_names": features, "aggregate_output": how, "target_type": kind, "trained_models": trees}}, "input": {"field_names": features}})


def aggregate_inference(values, how: str, weights: list[float] | None = None):
    """A column that puts an array of tree outputs together: weighted_sum, logistic_regression, exponent, weighted_mode."""
    w = F.array(*map(F.lit, weights)) if weights else F.transform(values, lambda _: F.lit(1.0))
    total = F.aggregate(F.zip_with(values, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    if how == "weighted_sum":
        return total
    if how == "logistic_regression":
        return 1 / (1 + F.exp(-total))
    if how == "exponent":
        return F.exp(total)
    if how == "weighted_mode":
        pairs = F.arrays_zip(values.alias("v"), w.alias("w"))
        sums = F.transform(F.array_distinct(values), lambda x: F.struct(F.aggregate(F.filter(pairs, lambda p: p["v"] == x), F.lit(0.0), lambda s, p: s + p["w"]).alias("w"), (-x).alias("n")))
        return -F.array_max(sums)["n"]
    raise ValueError(how)


