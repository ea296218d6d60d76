"""Nearest neighbours against brute force, and what the pivot join leaves out."""

import math

import numpy as np
import pytest

from driftwell.operators import neighbours as N
from driftwell.operators import outliers


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1.0) for i, v in rows], f"id long, v {kind}, key string, distance double").repartition(4)


def brute(rows, k):
    by = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == len(rows[0][1]) and all(c is not None and math.isfinite(c) for c in v):
            by[i] = min(by.get(i, tuple(map(float, v))), tuple(map(float, v)))
    ids = np.array(sorted(by))
    x = np.array([by[i] for i in ids])
    out = {}
    for a, i in enumerate(ids):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        order = [b for b in np.lexsort((ids, d)) if b != a][:k]
        out[int(i)] = [(int(ids[b]), float(d[b])) for b in order]
    return out


def found(df, k, part):
    out = {}
    for r in N.neighbours(df, "id", "v", k, part).orderBy("key", "rank").collect():
        out.setdefault(r["key"], []).append((r["neighbour"], r["distance"]))
        assert r["rank"] == len(out[r["key"]])
    return out


def same(got, want):
    assert got.keys() == {i for i in want if want[i]}
    for i in got:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]]
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], abs=1e-9)


def clustered(n, d=6, clusters=40, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-100, 100, (clusters, d))
    return [(i, (centres[i % clusters] + rng.normal(0, 1, d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", ["clustered", "uniform", "grid", "line", "far apart"])
def test_exact(spark, rows):
    rng = np.random.default_rng(1)
    rows = {
        "clustered": clustered(900), "uniform": [(i, rng.normal(size=8).tolist()) for i in range(600)],
        "grid": [(31 * i % 625, [i % 25, i // 25]) for i in range(625)], "line": [(i, [float(i)]) for i in range(500)],
        "far apart": [(i, [1e8 + i % 7, 1e-3 * (i % 11), i]) for i in range(400)],
    }[rows]
    same(found(frame(spark, rows), 5, 64), brute(rows, 5))


def test_many_equal_vectors(spark):
    rows = [(5 * i, [0.5, -0.0]) for i in range(2000)] + [(5 * i + 1, [0.5, 0.0 + i]) for i in range(30)] + [(-3, [0.5, 1.0]), (10_001, [0.5, 1.0])]
    got = found(frame(spark, rows), 5, 256)
    same(got, brute(rows, 5))
    assert got[9995] == [(0, 0.0), (1, 0.0), (5, 0.0), (10, 0.0), (15, 0.0)]


def test_odd_vectors_and_ids(spark):
    fine = clustered(60, d=3, clusters=2)
    odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [None, 0.0, 0.0]), (104, [math.nan, 0.0, 0.0]), (105, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    repeated = [fine[3], fine[3], (7, [50.0, 50.0, 50.0])]
    same(found(frame(spark, fine + odd + repeated), 4, 16), brute(fine + odd + repeated, 4))
    with pytest.raises(ValueError):
        N.neighbours(frame(spark, fine), "key", "v", 3)


def test_few_points(spark):
    for rows in ([], [(1, [1.0])], [(1, [1.0]), (2, [1.0])], [(i, [float(i)]) for i in range(4)]):
        same(found(frame(spark, rows), 5, 2), brute(rows, 5) if rows else {})


def test_most_pairs_are_left_out_of_clusters(spark):
    rows = clustered(8000, d=8, clusters=60)
    df = frame(spark, rows)
    assert N.pairs_met(df, "id", "v", 5, part=128) < 8000 * 8000 / 10
    near = found(df, 5, 128)
    x = np.array([v for _, v in rows])
    for i in range(0, 8000, 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert [n for n, _ in near[i]] == [b for b in np.lexsort((np.arange(8000), d)) if b != i][:5]


def test_rings_hold_several_parts(spark, monkeypatch):
    rows = clustered(700, d=4, clusters=5)
    monkeypatch.setattr(N.with_rings, "__defaults__", (6,))
    same(found(frame(spark, rows), 3, 16), brute(rows, 3))


def test_lof_of_copies(spark):
    rows = [(i, [0.0, 0.0]) for i in range(10)] + [(20 + i, [5.0 + i % 4, i // 4]) for i in range(16)] + [(99, [40.0, 40.0])]
    knn = N.neighbours(frame(spark, rows), "id", "v", 3)
    got = {r["key"]: r["score"] for r in outliers.lof(knn).collect()}
    assert all(got[i] == pytest.approx(1.0) for i in range(10)) and got[99] == max(got.values()) > 5
    only = {r["key"]: r["score"] for r in outliers.lof(N.neighbours(frame(spark, rows[:10]), "id", "v", 3)).collect()}
    assert set(only.values()) == {1.0}


def test_vectors_do_not_travel_to_meet(spark):
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(400)]
    points, n, _, d = N.of_one_length(N.distinct_points(N.usable(frame(spark, rows), "id", "v"), 3))
    asks, held, _, tables = N.rings_of(points, n, d, 3, 16)
    plan = N.pairs_of(asks, held)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    N.dropped(*tables)
