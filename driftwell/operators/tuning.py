"""Bayesian search of hyperparameters: a Gaussian process over the trials so far, and the point of most expected improvement.

The trials are few and the driver's; what a trial costs is training on folds of the whole table, which Spark does.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import trees as T


@dataclass(frozen=True)
class Range:
    """Values from low to high, evenly or by their logarithm; whole numbers only where asked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float:
        v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return int(min(round(v), self.high)) if self.whole else v


def kernel(a: np.ndarray, b: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Matern's covariance of smoothness 5/2, a scale for each coordinate."""
    d = np.sqrt(5 * (((a[:, None] - b[None]) / scales) ** 2).sum(2))
    return (1 + d + d * d / 3) * np.exp(-d)


class Process:
    """Values at points of the unit cube, whose scales and noise are those of most likelihood on a coordinate-wise grid."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.size = x, y.mean(), y.std() or 1.0
        self.z = (y - self.mean) / self.size
        self.scales, self.noise = np.full(x.shape[1], 0.5), 1e-4
        best = self.likelihood(self.scales, self.noise)
        for _ in range(2):
            for j in range(x.shape[1]):
                for s in (0.1, 0.2, 0.4, 0.8, 1.6, 5.0):
                    tried = np.where(np.arange(x.shape[1]) == j, s, self.scales)
                    if (value := self.likelihood(tried, self.noise)) > best:
                        best, self.scales = value, tried
            for noise in (1e-6, 1e-4, 1e-2, 1e-1):
                if (value := self.likelihood(self.scales, noise)) > best:
                    best, self.noise = value, noise
        self.factor = np.linalg.cholesky(kernel(x, x, self.scales) + self.noise * np.eye(len(x)))
        self.weights = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, self.z))

    def likelihood(self, scales: np.ndarray, noise: float) -> float:
        k = np.linalg.cholesky(kernel(self.x, self.x, scales) + (noise + 1e-10) * np.eye(len(self.x)))
        a = np.linalg.solve(k, self.z)
        return float(-0.5 * a @ a - np.log(np.diag(k)).sum())

    def foretold(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at points."""
        k = kernel(x, self.x, self.scales)
        v = np.linalg.solve(self.factor, k.T)
        return self.mean + self.size * (k @ self.weights), self.size * np.sqrt(np.maximum(1 - (v * v).sum(0), 1e-12))

    def improvement(self, x: np.ndarray) -> np.ndarray:
        """How far below the best value so far a trial at each point is expected to come."""
        m, s = self.foretold(x)
        best = self.mean + self.size * self.z.min()
        u = (best - m) / s
        cdf = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in u]))
        return s * (u * cdf + np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi))


def search(objective: Callable[[dict], float], space: dict[str, Range], trials: int = 20, first: int = 5, seed: int = 1) -> tuple[dict, float, list[tuple[dict, float]]]:
    """(best parameters, their value, all trials in order): the objective made small.  A trial without a finite value counts as the worst so far."""
    rng, names = np.random.default_rng(seed), list(space)
    d, points, found = len(names), [], []
    # the first trials are spread evenly in each coordinate
    start = (np.stack([rng.permutation(first) for _ in names], axis=1) + rng.random((first, d))) / first
    for i in range(trials):
        if i < first:
            u = start[i]
        else:
            values = np.array([v for _, v in found])
            worst = values[np.isfinite(values)].max(initial=0.0)
            process = Process(np.array(points), np.where(np.isfinite(values), values, worst))
            near = np.array(points)[np.argsort(values)[:3]]
            tried = np.concatenate([rng.random((1000, d)), *(np.clip(p + rng.normal(0, w, (150, d)), 0, 1) for p in near for w in (0.1, 0.03))])
            u = tried[int(np.argmax(process.improvement(tried)))]
        params = {n: space[n].at(float(v)) for n, v in zip(names, u)}
        points.append(u)
        found.append((params, float(objective(params))))
    best = min(found, key=lambda f: (not math.isfinite(f[1]), f[1]))
    return *best, found


SPACE = {
    "eta": Range(0.05, 0.6, log=True), "depth": Range(2, 7, whole=True), "trees": Range(5, 60, log=True, whole=True),
    "leaf_weight": Range(0.01, 30.0, log=True), "tree_size": Range(1e-3, 10.0, log=True),
}


def tune(df: DataFrame, features: list[str], target: str, key: str, loss: str = "mse", width: float = 1.0, space: dict[str, Range] = SPACE, trials: int = 15, folds: int = 3, seed: int = 1, fixed: T.Parameters = T.Parameters()):
    """(model, parameters, trials): a model of all rows with the parameters of least held-out loss over the folds, which a hash of the key deals."""
    rows = df.where(F.col(target).isNotNull()).withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)))

    def held_out(params: dict) -> float:
        p = replace(fixed, **params)
        out = []
        for i in range(folds):
            model = T.fit(rows.where(F.col("_fold") != i), features, target, loss, width, p)
            out.append(T.loss_without(model, rows.where(F.col("_fold") == i), target)[0])
        return float(np.mean(out))

    params, _, found = search(held_out, space, trials, seed=seed)
    p = replace(fixed, **params)
    return T.fit(rows, features, target, loss, width, p), p, found
