"""Clustering from cluster features: counts, sums and squared lengths of near points, which add up in any order.

Every task brings its points down to a bounded number of features as it reads them, features of tasks meet in groups, and these
in one last group of bounded size.  They are a table: a later run adds its own.  Centres, their number and how surely
points belong together are found from the features alone, and every point then goes to its nearest centre.

Rows: vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another length than most (of
equally common lengths the longest counts); repeated rows count as often as they occur; an empty table has no features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.cluster import bic

SCHEMA = "n double, s array<double>, q double"
GROUPS = 64


def points(df: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """([key,] v) of the rows that take part."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.select(*([F.col(key).alias("key")] if key else []), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def weighted_k_means(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(centres, label of each point) of weighted points: k-means++ and rounds of means."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), 1, p=w / w.sum())]
    near = squared(x, centres)[:, 0]
    for _ in range(1, k):
        p = near * w
        if p.sum() <= 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), 1, p=p / p.sum())]])
        near = np.minimum(near, squared(x, centres[-1:])[:, 0])
    for _ in range(rounds):
        label = np.argmin(squared(x, centres), axis=1)
        held = np.bincount(label, w, len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x * w[:, None])
        moved = np.where(held[:, None] > 0, sums / np.maximum(held, 1e-300)[:, None], centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres, np.argmin(squared(x, centres), axis=1)


class Features:
    """At most `most` features: n, s (sums) and q (sums of squared lengths)."""

    def __init__(self, most: int, d: int):
        self.most, self.n, self.s, self.q = most, np.zeros(0), np.zeros((0, d)), np.zeros(0)

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        for at in range(0, len(n), 4 * self.most):
            part = slice(at, at + 4 * self.most)
            self.n, self.s, self.q = np.concatenate([self.n, n[part]]), np.vstack([self.s, s[part]]), np.concatenate([self.q, q[part]])
            if len(self.n) > self.most:
                self.reduce()

    def reduce(self) -> None:
        """Near features become one."""
        label = weighted_k_means(self.s / self.n[:, None], self.n, self.most, np.random.default_rng(len(self.n)), rounds=3)[1]
        k = label.max() + 1
        s = np.zeros((k, self.s.shape[1]))
        np.add.at(s, label, self.s)
        n, q = np.bincount(label, self.n, k), np.bincount(label, self.q, k)
        self.n, self.s, self.q = n[n > 0], s[n > 0], q[n > 0]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.n), pa.array(list(self.s), pa.list_(pa.float64())), pa.array(self.q)], ["n", "s", "q"])


def stacked(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def features_of(df: DataFrame, vector: str, most: int = 256) -> DataFrame:
    """(n, s, q): at most `most` features of all points."""
    rows = points(df, vector)

    def build(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch.column("v"))
                held = held or Features(most, x.shape[1])
                held.add(np.ones(len(x)), x, (x * x).sum(1))
        if held:
            yield held.batch()

    return merged(rows.mapInArrow(build, SCHEMA), most=most)


def merged(*tables: DataFrame, most: int = 256) -> DataFrame:
    """At most `most` features of all points that the tables' features hold."""

    def merge(table: pa.Table) -> pa.Table:
        s = stacked(table.column("s"))
        held = Features(most, s.shape[1])
        held.add(table.column("n").to_numpy(), s, table.column("q").to_numpy())
        return pa.Table.from_batches([held.batch()])

    rows = tables[0].select("n", "s", "q")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("n", "s", "q"))
    some = rows.withColumn("g", F.spark_partition_id() % GROUPS).groupBy("g").applyInArrow(merge, SCHEMA)
    return some.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(merge, SCHEMA)  # GROUPS * most rows at most


def taken(features: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = features.collect()  # a bounded number
    return np.array([r["n"] for r in rows]), np.array([r["s"] for r in rows]), np.array([r["q"] for r in rows])


def cost_of(n: np.ndarray, s: np.ndarray, q: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """(the points' squared distances from their clusters' means, exactly; the clusters' sizes)."""
    k = label.max() + 1
    sums = np.zeros((k, s.shape[1]))
    np.add.at(sums, label, s)
    held = np.bincount(label, n, k)
    return float(q.sum() - ((sums**2).sum(1)[held > 0] / held[held > 0]).sum()), held


def centres_of(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int, starts: int = 8, seed: int = 1) -> tuple[np.ndarray, float]:
    """(centres, cost): the best of several starts."""
    best = None
    for i in range(starts):
        centres, label = weighted_k_means(s / n[:, None], n, k, np.random.default_rng([seed, i]), rounds=50)
        cost, _ = cost_of(n, s, q, label)
        if best is None or cost < best[1]:
            best = centres, cost
    return best


def k_centres(features: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    n, s, q = taken(features)
    return centres_of(n, s, q, k, seed=seed)[0] if len(n) else np.zeros((0, 0))


def x_centres(features: DataFrame, most: int = 10, seed: int = 1) -> np.ndarray:
    """The centres, as many (up to `most`) as the Bayes information criterion is least for."""
    n, s, q = taken(features)
    best = None
    for k in range(1, min(most, len(n)) + 1):
        centres, cost = centres_of(n, s, q, k, seed=seed)
        label = np.argmin(squared(s / n[:, None], centres), axis=1)
        score = bic(cost, cost_of(n, s, q, label)[1].tolist(), s.shape[1])
        if best is None or score < best[0]:
            best = score, centres
    return best[1] if best else np.zeros((0, 0))


def bootstrap_centres(features: DataFrame, k: int, samples: int = 40, together: float = 0.5, seed: int = 1) -> list[np.ndarray]:
    """Groups of features, each as its features' means, that more than a share of resampled clusterings put together, directly or by others.

    Clusters of any shape come out, as k small ones chain up; k is how finely each resample is cut.
    """
    n, s, _ = taken(features)
    x, rng = s / n[:, None], np.random.default_rng(seed)
    both, drawn = np.zeros((len(n), len(n))), np.zeros((len(n), len(n)))
    for _ in range(samples):
        w = rng.poisson(1.0, len(n)) * n
        if not (w > 0).any():
            continue
        own = np.flatnonzero(w)
        label = weighted_k_means(x[own], w[own], k, rng)[1]
        both[np.ix_(own, own)] += label[:, None] == label
        drawn[np.ix_(own, own)] += 1
    linked = both > together * np.maximum(drawn, 1)
    root = np.arange(len(n))
    while True:
        least = np.where(linked, root, len(n)).min(1, initial=len(n))
        least = np.minimum(least, root)
        if (least == root).all():
            break
        root = least
    return [x[root == r] for r in np.unique(root)]


def nearest_centre(df: DataFrame, key: str, vector: str, centres: np.ndarray, groups: np.ndarray | None = None) -> DataFrame:
    """(key, cluster): each point's nearest centre, or the group that this is of."""
    shared = df.sparkSession.sparkContext.broadcast((centres, np.arange(len(centres)) if groups is None else groups))  # a bounded number

    def run(batches):
        c, g = shared.value
        for batch in batches:
            if batch.num_rows:
                label = g[np.argmin(squared(stacked(batch.column("v")), c), axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(label.astype(np.int32))], ["key", "cluster"])

    return points(df, vector, key).mapInArrow(run, f"key {dict(df.dtypes)[key]}, cluster int")


def bootstrap_clusters(df: DataFrame, key: str, vector: str, k: int, most: int = 256, samples: int = 40) -> DataFrame:
    """(key, cluster) by bootstrap_centres()."""
    found = bootstrap_centres(features_of(df, vector, most), k, samples)
    groups = np.repeat(np.arange(len(found)), [len(g) for g in found])
    return nearest_centre(df, key, vector, np.vstack(found) if found else np.zeros((0, 0)), groups)
