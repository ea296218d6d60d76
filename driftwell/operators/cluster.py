"""Clustering and simple classifiers: k-means, x-means, agglomerative, natural breaks, naive Bayes, random projections."""

from __future__ import annotations

import contextlib
import heapq
import math
import tempfile

import numpy as np
import pandas as pd
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def k_means(df: DataFrame, key: str, vector: str, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """(key, cluster)."""
    rows = vectors(df, key, vector)
    return KMeans(k=k, seed=seed, maxIter=rounds, predictionCol="cluster").fit(rows).transform(rows).select("key", "cluster")


def bic(cost: float, sizes: list[int], d: int) -> float:
    """Bayes information criterion of a k-means fit as a mixture of spheres of one variance."""
    n, k = sum(sizes), len(sizes)
    variance = max(cost / max(d * (n - k), 1), 1e-300)
    fit = n * d * (math.log(2 * math.pi * variance) + 1) - 2 * sum(s * math.log(s / n) for s in sizes if s)
    return fit + k * (d + 1) * math.log(max(n, 2))


def aic(cost: float, sizes: list[int], d: int) -> float:
    return bic(cost, sizes, d) + len(sizes) * (d + 1) * (2 - math.log(max(sum(sizes), 2)))


def x_means(df: DataFrame, key: str, vector: str, most: int = 10, seed: int = 1) -> tuple[DataFrame, int]:
    """((key, cluster), k) with the number of clusters (1 to `most`) of the least BIC."""
    rows = vectors(df, key, vector).cache()
    n, d, best = rows.count(), len(rows.first()["features"]), None
    for k in range(2, most + 1):
        m = KMeans(k=k, seed=seed, maxIter=20, predictionCol="cluster").fit(rows)
        score = bic(m.summary.trainingCost, list(m.summary.clusterSizes), d)
        if best is None or score < best[0]:
            best = (score, k, m)
    whole = Summarizer.metrics("variance")
    spread = rows.select(whole.summary(F.col("features")).getField("variance").alias("v")).first()["v"]
    if n < 2 or bic(float(sum(spread)) * (n - 1), [n], d) <= best[0]:
        return rows.select("key", F.lit(0).alias("cluster")), 1
    out = best[2].transform(rows).select("key", "cluster")
    return out, best[1]


def agglomerate(x: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a group's points, lowest first; single, complete, average, weighted or ward linkage.

    The n-th merge makes the cluster len(x) + n.  Points on a line take n log n steps, others the square of n: ward by centroids, in
    memory of the points alone, the other linkages by a table of all distances, in a file where it is large.
    """
    if linkage not in ("single", "complete", "average", "weighted", "ward"):
        raise ValueError(linkage)
    found = merges_on_line(x[:, 0], linkage) if x.shape[1] == 1 else merges_by_chains(x, linkage)
    of, label, out = list(range(len(x))), list(range(len(x))), []

    def first(i: int) -> int:
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    for step, (i, j, h) in enumerate(found):
        i, j = sorted((first(i), first(j)))
        out.append((label[i], label[j], float(math.sqrt(2 * h) if linkage == "ward" else h)))
        of[j], label[i] = i, len(x) + step
    return out


def merges_on_line(x: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """(i, j, height), lowest first, of points on a line; i and j are the first points of the clusters that merge.

    By each of the linkages the two nearest clusters lie side by side, so only those are kept in order.
    """
    order = np.argsort(x, kind="stable").tolist()
    n, first, alive = len(x), list(order), [True] * len(x)
    low = [float(x[i]) for i in order]
    high, centre, size = list(low), list(low), [1] * n
    left, right, turn = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n

    def height(p: int, q: int) -> float:
        if linkage == "single":
            return low[q] - high[p]
        if linkage == "complete":
            return high[q] - low[p]
        if linkage == "ward":
            return size[p] * size[q] / (size[p] + size[q]) * (centre[q] - centre[p]) ** 2
        return centre[q] - centre[p]

    entry = lambda p, q: (height(p, q), *sorted((first[p], first[q])), p, q, turn[p], turn[q])
    heap = [entry(p, p + 1) for p in range(n - 1)]
    heapq.heapify(heap)
    out = []
    while heap:
        h, i, j, p, q, *at = heapq.heappop(heap)
        if not (alive[p] and alive[q]) or at != [turn[p], turn[q]]:
            continue
        out.append((i, j, h))
        share = 0.5 if linkage == "weighted" else size[q] / (size[p] + size[q])
        centre[p] += (centre[q] - centre[p]) * share
        high[p], size[p], first[p], alive[q] = high[q], size[p] + size[q], i, False
        turn[p] += 1
        right[p] = right[q]
        if right[p] < n:
            left[right[p]] = p
            heapq.heappush(heap, entry(p, right[p]))
        if left[p] >= 0:
            heapq.heappush(heap, entry(left[p], p))
    return out


def merges_by_chains(x: np.ndarray, linkage: str, in_memory: int = 4096) -> list[tuple[int, int, float]]:
    """(i, j, height), lowest first, by chains of nearest neighbours; i and j are the first points of the clusters that merge."""
    n = len(x)
    size, alive, reached, out, chain = np.ones(n), np.ones(n, bool), np.zeros(n), [], []
    with tempfile.TemporaryFile() if n > in_memory and linkage != "ward" else contextlib.nullcontext() as file:
        centre, d = x.astype(float), None
        if linkage != "ward":
            d = np.memmap(file, float, "w+", shape=(n, n)) if file else np.empty((n, n))
            for i in range(n):
                d[i] = np.sqrt(((x - x[i]) ** 2).sum(1))

        def distances(i: int) -> np.ndarray:
            out = size[i] * size / (size[i] + size) * ((centre - centre[i]) ** 2).sum(1) if d is None else np.array(d[i])
            out[~alive] = out[i] = np.inf
            return out

        while len(out) < n - 1:
            if not chain:
                chain.append(int(np.argmax(alive)))
            near = distances(chain[-1])
            best = int(np.argmin(near))
            if len(chain) > 1 and near[chain[-2]] <= near[best]:
                best = chain[-2]
            if len(chain) < 2 or best != chain[-2]:
                chain.append(best)
                continue
            i, j = sorted((chain.pop(), chain.pop()))
            # rounding must not put a merge before those that made its clusters
            h = max(float(near[best]), reached[i], reached[j])
            out.append((i, j, h))
            if d is None:
                centre[i] += (centre[j] - centre[i]) * (size[j] / (size[i] + size[j]))
            else:
                a, b = np.array(d[i]), np.array(d[j])
                if linkage == "single":
                    a = np.minimum(a, b)
                elif linkage == "complete":
                    a = np.maximum(a, b)
                else:
                    share = 0.5 if linkage == "weighted" else size[j] / (size[i] + size[j])
                    a += (b - a) * share
                d[i], d[:, i] = a, a
            size[i] += size[j]
            reached[i], alive[j] = h, False
    return sorted(out, key=lambda m: m[2])


def agglomerative(df: DataFrame, group: str, key: str, vector: str, linkage: str = "average") -> DataFrame:
    """(group, a, b, height, step): merges within each group, of any size; a group is one task's.

    Vectors that are null or hold null or non-finite entries take no part.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        ids = pdf["key"].tolist()
        merges = agglomerate(np.array(pdf["v"].tolist(), float), linkage) if len(pdf) > 1 else []
        name = lambda i: ids[i] if i < len(ids) else -(i - len(ids) + 1)
        rows = [(pdf["grp"].iloc[0], name(a), name(b), h, s + 1) for s, (a, b, h) in enumerate(merges)]
        return pd.DataFrame(rows, columns=["grp", "a", "b", "height", "step"])

    kind = dict(df.dtypes)[group]
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", fine))
    return rows.groupBy("grp").applyInPandas(run, f"grp {kind}, a long, b long, height double, step int")


def natural_breaks(x: np.ndarray, k: int, bins: int = 512) -> list[float]:
    """Upper ends of k classes with the least spread within, by dynamic programming over quantile bins."""
    x = np.sort(x)
    if len(x) > bins:
        cut = np.linspace(0, len(x), bins + 1).astype(int)
        parts = [x[a:b] for a, b in zip(cut, cut[1:]) if b > a]
    else:
        parts = [x[i : i + 1] for i in range(len(x))]
    w = np.array([len(p) for p in parts], float)
    s, q = np.array([p.sum() for p in parts]), np.array([(p * p).sum() for p in parts])
    cw, cs, cq = (np.concatenate([[0], np.cumsum(v)]) for v in (w, s, q))
    m, k = len(parts), min(k, len(parts))
    cost = lambda a, b: (cq[b] - cq[a]) - (cs[b] - cs[a]) ** 2 / np.maximum(cw[b] - cw[a], 1e-300)
    best, back = cost(0, np.arange(m + 1)), []
    for _ in range(1, k):
        new, at = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for b in range(1, m + 1):
            c = best[:b] + cost(np.arange(b), b)
            at[b] = int(np.argmin(c))
            new[b] = c[at[b]]
        best, back = new, [*back, at]
    ends, b = [], m
    for at in reversed(back):
        ends.append(float(parts[b - 1][-1]))
        b = at[b]
    return sorted([*ends, float(parts[max(b, 1) - 1][-1])])


def break_columns(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(group, class, upper) of each group, from 512 quantiles of it (a sketch, so groups may be of any size)."""
    q = df.groupBy(F.col(group).alias("grp")).agg(F.percentile_approx(F.col(value).cast("double"), [i / 512 for i in range(1, 513)], 10_000).alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = natural_breaks(np.array(pdf["q"].iloc[0], float), k)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "class": range(1, len(ends) + 1), "upper": ends})

    return q.groupBy("grp").applyInPandas(run, f"grp {dict(q.dtypes)['grp']}, class int, upper double")


def naive_bayes(df: DataFrame, vector: str, label: str):
    """A Gaussian naive Bayes model."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return NaiveBayes(modelType="gaussian").fit(rows)


def project(df: DataFrame, key: str, vector: str, d: int, seed: int = 2) -> DataFrame:
    """(key, projected): a random projection to d dimensions; signs come from a hash, so no matrix is sent."""
    terms = lambda j: F.aggregate(
        F.transform(vector, lambda v, i: v.cast("double") * F.when(F.pmod(F.xxhash64(i, F.lit(seed * 997 + j)), F.lit(2)) == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, v: s + v
    )
    return df.select(F.col(key).alias("key"), F.array(*[terms(j) / math.sqrt(d) for j in range(d)]).alias("projected"))
