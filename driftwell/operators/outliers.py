"""Outlier detection by nearest neighbours.

Neighbours are exact at every size (operators/neighbours.py).  The ensemble's members look at bounded samples, as that is
the method.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.frame import bounded_sample
from driftwell.operators.neighbours import neighbours, usable
from driftwell.sources.tables import written

METHODS = ("lof", "ldof", "distance_kth_nn", "distance_knn")
TOGETHER, MEETING = 64, 16  # blocks of series in a file; files, where there are blocks enough
MEMBER_ROWS = 10_000  # points in a member's sample at most, so that what tasks are given is bounded


def reference(rows: DataFrame, most: int) -> np.ndarray:
    """Points of a sample bounded by `most`, for the ensemble's members."""
    return np.array([r["v"] for r in bounded_sample(rows, most, "id").select("v").collect()], float)


def distance_kth_nn(knn: DataFrame) -> DataFrame:
    return knn.groupBy("key").agg(F.max("distance").alias("score"))


def distance_knn(knn: DataFrame) -> DataFrame:
    return knn.groupBy("key").agg(F.avg("distance").alias("score"))


def lof(knn: DataFrame) -> DataFrame:
    """(key, score): neighbours' mean local reachability density over the point's own.

    A point among so many copies that nothing lies apart has twice the largest density of any other; without any other, all are 1.
    """
    kdist = knn.groupBy(F.col("key").alias("neighbour")).agg(F.max("distance").alias("kdist"))
    reach = knn.join(kdist, "neighbour").groupBy("key").agg(F.avg(F.greatest("distance", "kdist")).alias("reach"))
    least = reach.where("reach > 0").agg(F.min("reach").alias("least"))
    lrd = reach.join(F.broadcast(least)).select("key", F.when(F.col("reach") > 0, 1 / F.col("reach")).otherwise(F.coalesce(2 / F.col("least"), F.lit(1.0))).alias("lrd"))
    theirs = lrd.select(F.col("key").alias("neighbour"), F.col("lrd").alias("theirs"))
    return knn.join(theirs, "neighbour").groupBy("key").agg(F.avg("theirs").alias("theirs")).join(lrd, "key").select("key", (F.col("theirs") / F.col("lrd")).alias("score"))


def ldof(df: DataFrame, key: str, vector: str, knn: DataFrame) -> DataFrame:
    """(key, score): mean distance to the neighbours over the mean distance among them (at most k*k pairs a point)."""
    v = usable(df, key, vector).select(F.col("id").alias("neighbour"), "v")
    sets = knn.join(v, "neighbour").groupBy("key").agg(F.collect_list("v").alias("vs"), F.avg("distance").alias("outer"))

    def run(vs: pd.Series) -> pd.Series:
        def inner(rows):
            x = np.array([list(r) for r in rows], float)
            if len(x) < 2:
                return 0.0
            d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
            return float(d.sum() / (len(x) * (len(x) - 1)))

        return vs.map(inner)

    return sets.select("key", "outer", F.pandas_udf(run, "double")("vs").alias("inner")).select(
        "key", (F.col("outer") / F.greatest(F.col("inner"), F.lit(1e-12))).alias("score")
    )


def ensemble_plan(n: int, d: int) -> tuple[int, int, int, int]:
    """(members, sample rows, neighbours, projected dimension) for n points of dimension d; samples stop growing at MEMBER_ROWS."""
    sample = min(MEMBER_ROWS, max(10, int(10 * math.sqrt(n))))
    k = int(min(max(0.01 * sample, 5), 100))
    wide = int(min(max(min(d, math.log(sample, 3)), 2), 10))
    members = int(min(max(2 * math.ceil(d / wide), math.sqrt(n) / 5, 6), 20))
    return members, sample, k, min(wide, d)


def ensemble(df: DataFrame, key: str, vector: str, outlier_fraction: float = 0.05, seed: int = 3, influence: bool = False, threshold: float = 0.1) -> DataFrame:
    """(key, outlier_score[, influences]): several models on samples of projected points, combined by Bayes' rule.

    Every member has its own random projection and sample; a point's distances are held against the sample's
    own, whose log scores are taken as normal.  Influences, each coordinate's share in the score, are given for scores over the
    threshold and null for others: with one coordinate at its mean a projection moves along one line, so nothing is projected anew.
    """
    rows = usable(df, key, vector)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n = most["count"] if most else 0
    rows = rows.where(F.size("v") == (most["d"] if most else 0))
    if not n:
        empty = rows.select(F.col("id").alias("key"), F.lit(0.0).alias("outlier_score"))
        return empty.withColumn("influences", F.lit(None).cast("array<double>")) if influence else empty
    points = reference(rows, min(n, 3 * MEMBER_ROWS, max(2000, int(30 * math.sqrt(n)))))
    members, size, k, wide = ensemble_plan(n, points.shape[1])
    mean, spread = points.mean(0), np.where(points.std(0) > 0, points.std(0), 1.0)
    rng, parts = np.random.default_rng(seed), []

    def distances(x, ref, kth, skip):
        d2 = np.maximum((x * x).sum(1)[:, None] + (ref * ref).sum(1) - 2 * x @ ref.T, 0)
        near = np.sqrt(np.partition(d2, min(kth + skip, len(ref) - 1), axis=1)[:, skip : kth + skip])
        return np.log(near.mean(1) + 1e-12)

    for _ in range(members):
        project = np.linalg.qr(rng.normal(size=(points.shape[1], wide)))[0]
        ref = ((points[rng.permutation(len(points))[:size]] - mean) / spread) @ project
        own = distances(ref, ref, min(k, len(ref) - 1) or 1, 1) if len(ref) > 2 else np.zeros(len(ref))
        parts.append((project, ref, own.mean(), max(own.std(), 1e-6)))
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def odds(z, ref, m, s):
        # outliers: the same spread, three deviations out
        return np.clip(((distances(z, ref, min(k, len(ref)), 0) - m) / s - 1.5) * 3, -20, 20)

    def score(logs):
        lift = np.exp(np.clip(logs / (0.8 * members), -50, 50)) * outlier_fraction
        return lift / (lift + 1 - outlier_fraction)

    def shares(x, scored):
        """Of each row: how far the score falls with each coordinate at its mean, as shares of one."""
        out = []
        for row, full in zip(x, scored):
            logs = np.zeros(len(row))
            for project, ref, m, s in shared.value:
                logs += odds(row @ project - row[:, None] * project, ref, m, s)
            gain = np.maximum(full - score(logs), 0) + 1e-12
            out.append(gain / gain.sum())
        return out

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                x = (np.array(part["v"].tolist(), float) - mean) / spread
                logs = np.zeros(len(x))
                for project, ref, m, s in shared.value:
                    logs += odds(x @ project, ref, m, s)
                out = pd.DataFrame({"key": part["id"].to_numpy(np.int64), "outlier_score": score(logs)})
                if influence:
                    above = np.flatnonzero(out["outlier_score"].to_numpy() > threshold)
                    given = dict(zip(above.tolist(), shares(x[above], out["outlier_score"].to_numpy()[above])))
                    out["influences"] = [given.get(i) for i in range(len(out))]
                yield out

    schema = "key long, outlier_score double" + (", influences array<double>" if influence else "")
    return rows.mapInPandas(run, schema)


def most_correlated(df: DataFrame, series: str, bucket: str, value: str, top: int = 10, block: int = 512) -> DataFrame:
    """(a, b, correlation): the pairs of series most correlated over the buckets that both have, more than two; ties by a, b.

    Exact: series are dealt in blocks, which are written; every two blocks meet once, where a task reads both, so that no series travels
    to meet another, and all of a pair of blocks' sums over shared buckets are matrix products.  Only each pair of blocks' best go on.
    A series is as long as it has buckets; a bucket is held once.
    """
    times = df.select(bucket).distinct()
    place = times.withColumn("_i", F.row_number().over(Window.orderBy(bucket)) - 1)  # as many rows as there are buckets
    wide = times.count()
    rows, kind = df.where(F.col(value).isNotNull() & F.col(series).isNotNull()).join(place, bucket), dict(df.dtypes)[series]
    count = rows.select(series).distinct().count()
    blocks = max(1, -(-count // block))
    lists = rows.groupBy(F.col(series).alias("s")).agg(
        F.collect_list(F.struct(F.col("_i").cast("int").alias("i"), F.col(value).cast("double").alias("v"))).alias("points")
    )
    dealt = lists.withColumn("k", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full((len(pdf), wide), np.nan)
        for row, points in enumerate(pdf["points"]):
            for q in points:
                x[row, q["i"]] = q["v"]
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "ids": [pdf["s"].tolist()], "x": [x.tobytes()]})

    # in files of up to TOGETHER blocks, each task reading two of them: a product of files, without a shuffle
    packed = written(dealt.groupBy("k").applyInPandas(pack, f"k int, ids array<{kind}>, x binary").repartition(min(blocks, max(MEETING, -(-blocks // TOGETHER))), "k"))
    other = packed.select(F.col("k").alias("l"), F.col("ids").alias("jds"), F.col("x").alias("y"))
    pairs = packed.hint("shuffle_replicate_nl").join(other, F.col("k") <= F.col("l"))

    def meet(batches):
        for pdf in batches:
            for ids, x, jds, y in zip(pdf["ids"], pdf["x"], pdf["jds"], pdf["y"]):
                ids, jds = np.array(list(ids)), np.array(list(jds))
                x, y = (np.frombuffer(m, float).reshape(-1, wide) for m in (x, y))
                yield best_pairs(ids, x, jds, y, top)

    best = pairs.select("ids", "x", "jds", "y").mapInPandas(meet, f"a {kind}, b {kind}, correlation double")
    return best.orderBy(F.desc(F.abs("correlation")), "a", "b").limit(top)


def best_pairs(ids: np.ndarray, x: np.ndarray, jds: np.ndarray, y: np.ndarray, top: int) -> pd.DataFrame:
    """(a, b, correlation) of the `top` most correlated pairs, a < b, of the rows of x and y; NaN where a row has no value."""
    here, there = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    # about each row's mean, so that sums of squares keep their digits
    x, y = (np.nan_to_num(m - np.nansum(m, 1, keepdims=True) / np.maximum(1, k.sum(1, keepdims=True))) for m, k in ((x, here), (y, there)))
    n, sx, sy = here @ there.T, x @ there.T, here @ y.T
    vx, vy = n * ((x * x) @ there.T) - sx * sx, n * (here @ (y * y).T) - sy * sy
    with np.errstate(all="ignore"):
        r = np.where((n > 2) & (vx > 1e-9) & (vy > 1e-9), (n * (x @ y.T) - sx * sy) / np.sqrt(vx * vy), np.nan)
    # a block with itself holds every pair twice
    fit = ~np.isnan(r) & (ids[:, None] < jds if np.array_equal(ids, jds) else ids[:, None] != jds)
    size = np.where(fit, np.abs(r), -1.0)
    # only those as large as the last of the best are put in order
    least = np.partition(size, size.size - top, axis=None)[size.size - top] if size.size > top else -1.0
    i, j = np.nonzero(fit & (size >= least))
    a, b, value = ids[i], jds[j], r[i, j]
    left, right = np.where(a < b, a, b), np.where(a < b, b, a)
    order = np.lexsort((right, left, -np.abs(value)))[:top]
    return pd.DataFrame({"a": left[order], "b": right[order], "correlation": np.clip(value[order], -1, 1)})
