"""Agglomerative clustering of groups of any size against a plain search of all distances."""

import math

import numpy as np
import pytest

from driftwell.operators import cluster


def every_distance(x: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """Merges by a table of all distances, searched whole at each step."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    if linkage == "ward":
        d = d**2 / 2
    np.fill_diagonal(d, np.inf)
    size, label, out = np.ones(n), list(range(n)), []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        out.append((label[i], label[j], float(math.sqrt(2 * h) if linkage == "ward" else h)))
        a, b = d[i].copy(), d[j].copy()
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage == "weighted":
            new = (a + b) / 2
        else:
            with np.errstate(invalid="ignore"):
                new = ((size[i] + size) * a + (size[j] + size) * b - size * h) / (size[i] + size[j] + size)
        new[~np.isfinite(b) | ~np.isfinite(a)] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[i] = n + step
    return out


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "weighted", "ward"])
@pytest.mark.parametrize("d", [1, 3])
def test_merges(linkage, d):
    rng = np.random.default_rng(4)
    for n in (2, 3, 40, 150):
        x = rng.normal(size=(n, d)) * 100
        want, got = every_distance(x, linkage), cluster.agglomerate(x, linkage)
        assert [m[:2] for m in got] == [m[:2] for m in want]
        assert [m[2] for m in got] == pytest.approx([m[2] for m in want])


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_merges_of_copies(linkage):
    x = np.tile(np.random.default_rng(5).integers(0, 2**20, 30) + 0.1, 4)[:, None]
    want, got = every_distance(x, linkage), cluster.agglomerate(x, linkage)
    assert [m[:2] for m in got] == [m[:2] for m in want]
    assert [m[2] for m in got] == pytest.approx([m[2] for m in want])


def test_table_of_distances_in_a_file():
    x = np.random.default_rng(6).normal(size=(60, 2))
    assert cluster.merges_by_chains(x, "average", in_memory=10) == cluster.merges_by_chains(x, "average")


def test_groups_of_many_rows(spark):
    df = spark.range(7000).selectExpr("id", "id % 2 AS g", "array(CAST(id * id % 10007 AS DOUBLE)) AS v").unionAll(spark.sql("SELECT 7000L, 0L, array(CAST(NULL AS DOUBLE))"))
    rows = cluster.agglomerative(df, "g", "id", "v", "ward").collect()
    assert len(rows) == 2 * 3499
    for g in (0, 1):
        mine = sorted((r["step"], r["height"], r["a"], r["b"]) for r in rows if r["grp"] == g)
        assert all(a[1] <= b[1] + 1e-9 for a, b in zip(mine, mine[1:]))
        assert len({i for m in mine for i in m[2:]}) == 2 * 3499
