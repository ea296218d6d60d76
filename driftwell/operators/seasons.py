"""Seasonal components whose buckets lie where the errors are, with a periodic cubic spline through them.

Values meet in fine phases of the period, whose counts and sums merge before the shuffle; a key's fine phases are few, and its
end points, means and spline come from them alone.

Rows: null buckets and values take no part; a null key is a key; a key with fewer than four distinct phases gets its mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def end_points(n: np.ndarray, mean: np.ndarray, buckets: int, rounds: int = 20, even: float = 0.25) -> np.ndarray:
    """Where `buckets` buckets over fine phases end, moved until each holds an equal share of the error that their means leave.

    A share `even` of each fine phase's part stays the same for all, so that no bucket grows without end.
    """
    size = len(n)
    ends = np.linspace(0, size, buckets + 1)
    for _ in range(rounds):
        label = np.clip(np.searchsorted(ends, np.arange(size) + 0.5, "right") - 1, 0, buckets - 1)
        held = np.bincount(label, n, buckets)
        centre = np.bincount(label, n * mean, buckets) / np.maximum(held, 1e-300)
        error = n * np.abs(mean - centre[label])
        mass = even / size + (1 - even) * error / max(error.sum(), 1e-300)
        upto = np.concatenate([[0], np.cumsum(mass)])
        moved = np.interp(np.linspace(0, upto[-1], buckets + 1), upto, np.arange(size + 1))
        ends = 0.5 * (ends + moved)
    return ends


def periodic_spline(x: np.ndarray, y: np.ndarray, period: float) -> np.ndarray:
    """Second derivatives at the knots of the periodic cubic spline through (x, y), x rising within one period."""
    m = len(x)
    h = np.diff(np.append(x, x[0] + period))
    a, r = np.zeros((m, m)), np.zeros(m)
    for i in range(m):
        before, after = h[i - 1], h[i]
        a[i, i - 1] += before / 6
        a[i, i] += (before + after) / 3
        a[i, (i + 1) % m] += after / 6
        r[i] = (y[(i + 1) % m] - y[i]) / after - (y[i] - y[i - 1]) / before
    return np.linalg.solve(a, r)


def spline_at(x: np.ndarray, y: np.ndarray, curve: np.ndarray, period: float, at: np.ndarray) -> np.ndarray:
    """The spline's values."""
    knots, v, c = np.append(x, x[0] + period), np.append(y, y[0]), np.append(curve, curve[0])
    at = np.where(at < x[0], at + period, at)
    i = np.clip(np.searchsorted(knots, at, "right") - 1, 0, len(x) - 1)
    h = knots[i + 1] - knots[i]
    a, b = (knots[i + 1] - at) / h, (at - knots[i]) / h
    return a * v[i] + b * v[i + 1] + ((a**3 - a) * c[i] + (b**3 - b) * c[i + 1]) * h * h / 6


def season_of(n: np.ndarray, mean: np.ndarray, buckets: int) -> np.ndarray:
    """The component at each fine phase; phases without values are bridged."""
    size, whole = len(n), float((n * mean).sum() / n.sum())
    if (n > 0).sum() < 4:
        return np.full(size, whole)
    known = np.flatnonzero(n)
    filled = np.where(n > 0, mean, np.interp(np.arange(size), known, mean[known], period=size))
    ends = end_points(np.maximum(n, n[known].mean() * 1e-3), filled, min(buckets, len(known)))
    label = np.clip(np.searchsorted(ends, np.arange(size) + 0.5, "right") - 1, 0, len(ends) - 2)
    held = np.bincount(label, n, len(ends) - 1)
    live = held > 0
    y = (np.bincount(label, n * filled, len(ends) - 1)[live]) / held[live]
    x = (np.bincount(label, n * (np.arange(size) + 0.5), len(ends) - 1)[live]) / held[live]
    if len(x) < 3:
        return np.full(size, whole)
    return spline_at(x, y, periodic_spline(x, y, size), size, np.arange(size) + 0.5)


def seasonal_component(df: DataFrame, keys: list[str], bucket: str, value: str, period: int, buckets: int = 24, fine: int = 288) -> DataFrame:
    """(keys, phase, count, mean, fitted): each fine phase's values and the component there; phase is in seconds from the period's start."""
    kinds = dict(df.dtypes)
    step = period // min(fine, period)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull() & F.col(bucket).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], (F.floor(F.pmod(F.col(bucket), F.lit(period)) / step)).cast("int").alias("p"), F.col(value).cast("double").alias("v"))
    sums = rows.groupBy(*names, "p").agg(F.count("v").alias("count"), F.avg("v").alias("mean"))
    size = -(-period // step)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = np.zeros(size), np.zeros(size)
        n[pdf["p"]], mean[pdf["p"]] = pdf["count"], pdf["mean"]
        return pdf.assign(fitted=season_of(n, mean, buckets)[pdf["p"]])

    out = sums.groupBy(*names).applyInPandas(run, ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys)) + ", p int, count long, mean double, fitted double")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], (F.col("p") * step).cast("long").alias("phase"), "count", "mean", "fitted")
