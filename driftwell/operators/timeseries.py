"""Decomposition, seasonality, change points, segmentation and forecasts of bucketed series, one series a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.expressions import DAY, WEEK
from driftwell.functions.special import f_right_tail

SIGNIFICANT = 5e-3
CHANGE_SIGNIFICANT = 1e-3
MOST_PERIODS = 8


def regular(pdf: pd.DataFrame, bucket: str, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, values) on every bucket from first to last; missing values carry a straight line."""
    pdf = pdf.dropna(subset=["value"]).groupby(bucket, as_index=False)["value"].mean().sort_values(bucket)
    t = pdf[bucket].to_numpy(np.int64)
    if not len(t):
        return t, np.empty(0)
    grid = np.arange(t[0], t[-1] + 1, span)
    return grid, np.interp(grid, t, pdf["value"].to_numpy(float))


def fit_trend(t: np.ndarray, x: np.ndarray, degree: int = 1) -> np.ndarray:
    """Coefficients of a polynomial in (t - t[0]) / (t[-1] - t[0]), least squares with outliers weighed down once."""
    u = (t - t[0]) / max(t[-1] - t[0], 1)
    a = np.vander(u, degree + 1)
    w = np.ones(len(x))
    c = np.zeros(degree + 1)
    for _ in range(2):
        c = np.linalg.lstsq(a * w[:, None], x * w, rcond=None)[0]
        r = np.abs(x - a @ c)
        s = 1.4826 * np.median(r) + 1e-12
        w = np.where(r > 4 * s, 0.1, 1.0)
    return c


def trend_at(c: np.ndarray, t: np.ndarray, first: int, last: int) -> np.ndarray:
    return np.polyval(c, (t - first) / max(last - first, 1))


def seasonal_table(t: np.ndarray, r: np.ndarray, period: int, span: int) -> np.ndarray:
    """Mean residual of each phase of a period."""
    phases = max(period // span, 1)
    at = (t // span) % phases
    n = np.bincount(at, minlength=phases)
    return np.bincount(at, r, phases) / np.maximum(n, 1)


def phase_p_value(t: np.ndarray, r: np.ndarray, period: int, span: int) -> float:
    """Chance of an analysis of variance over the period's phases at least this telling, if there were no season."""
    phases = max(period // span, 1)
    if phases < 2 or len(r) < 2 * phases:
        return 1.0
    fitted = seasonal_table(t, r, period, span)[(t // span) % phases]
    explained, left = float(np.sum((fitted - r.mean()) ** 2)), float(np.sum((r - fitted) ** 2))
    d1, d2 = phases - 1, len(r) - phases
    if left <= 1e-12 * max(explained, 1e-300):
        return 0.0 if explained > 0 else 1.0
    return f_right_tail((explained / d1) / (left / d2), d1, d2)


def autocorrelations(x: np.ndarray) -> np.ndarray:
    """Of all lags, by the Fourier transform."""
    x = x - x.mean()
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    a = np.fft.irfft(f * np.conj(f))[:n]
    return a / a[0] if n and a[0] > 0 else np.zeros(n)


def find_periods(t: np.ndarray, x: np.ndarray, span: int) -> list[tuple[int, float]]:
    """[(period, p)]: significant periods, strongest first: day and week, then the autocorrelation's peak."""
    if len(x) < 24:
        return []
    r = x - trend_at(fit_trend(t, x), t, t[0], t[-1])
    out: list[tuple[int, float]] = []
    for _ in range(MOST_PERIODS):
        tried = {p for p in (DAY, WEEK) if p % span == 0 and span < p <= (t[-1] - t[0]) // 2}
        a = autocorrelations(r)[: len(r) // 2]
        if len(a) > 3:
            peaks = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] >= a[2:]) & (a[1:-1] > 0.3)) + 1
            if len(peaks):
                tried.add(int(peaks[np.argmax(a[peaks])]) * span)
        tried -= {p for p, _ in out}
        tests = sorted((phase_p_value(t, r, p, span), p) for p in tried)
        if not tests or tests[0][0] > SIGNIFICANT:
            break
        p, period = tests[0]
        gain = np.var(seasonal_table(t, r, period, span)[(t // span) % (period // span)])
        if gain < 0.01 * max(np.var(r), 1e-300):
            break
        out.append((period, p))
        r = r - seasonal_table(t, r, period, span)[(t // span) % (period // span)]
    return out


def decompose_series(t: np.ndarray, x: np.ndarray, span: int) -> dict:
    """Trend coefficients, periods with their tables, and the parts at every bucket."""
    c = fit_trend(t, x)
    trend = trend_at(c, t, t[0], t[-1])
    periods, rest, season, tables = find_periods(t, x, span), x - trend, np.zeros(len(x)), []
    for period, _ in periods:
        table = seasonal_table(t, rest, period, span)
        part = table[(t // span) % len(table)]
        tables.append((period, table))
        season, rest = season + part, rest - part
    return {"coefficients": c, "trend": trend, "season": season, "rest": rest, "tables": tables}


def grouped(df: DataFrame, keys: list[str], bucket: str, value: str, schema: str, run) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rows = df.select(*keys, F.col(bucket).cast("long").alias(bucket), F.col(value).cast("double").alias("value"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(each, f"{head}, {schema}")


def decompose(df: DataFrame, keys: list[str], bucket: str, value: str, span: int) -> DataFrame:
    """(keys, bucket, actual, trend, seasonal, residual)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x = regular(pdf, bucket, span)
        if not len(t):
            return pd.DataFrame({c: [] for c in (bucket, "actual", "trend", "seasonal", "residual")})
        d = decompose_series(t, x, span)
        return pd.DataFrame({bucket: t, "actual": x, "trend": d["trend"], "seasonal": d["season"], "residual": d["rest"]})

    return grouped(df, keys, bucket, value, f"`{bucket}` long, actual double, trend double, seasonal double, residual double", run)


def seasonality(df: DataFrame, keys: list[str], bucket: str, value: str, span: int) -> DataFrame:
    """(keys, period, p_value) of each season found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x = regular(pdf, bucket, span)
        found = find_periods(t, x, span) if len(t) else []
        return pd.DataFrame({"period": [p for p, _ in found], "p_value": [q for _, q in found]}).astype({"period": "int64", "p_value": float})

    return grouped(df, keys, bucket, value, "period long, p_value double", run)


def detect_change(x: np.ndarray) -> tuple[str, int, float, float]:
    """(kind, place, size, p): the best of level shift, linear scale and time shift against no change."""
    n, none = len(x), ("none", -1, 0.0, 1.0)
    if n < 16:
        return none
    s0 = float(np.sum((x - x.mean()) ** 2))
    c1, c2 = np.cumsum(x), np.cumsum(x * x)
    at = np.arange(5, n - 5)
    left, right = c1[at - 1] / at, (c1[-1] - c1[at - 1]) / (n - at)
    s1 = c2[-1] - at * left**2 - (n - at) * right**2
    k = int(np.argmin(s1))
    best = [("level_shift", int(at[k]), float(right[k] - left[k]), float(max(s1[k], 0.0)), 2)]
    for p in at[:: max(1, len(at) // 64)]:
        a, b = x[:p], x[p:]
        if a.std() > 0 and abs(a.mean()) > 1e-9:
            m = min(len(a), len(b))
            ref, before = a[-m:], float(np.sum((a - a.mean()) ** 2))
            scale = float(ref @ b[:m] / max(ref @ ref, 1e-300))
            for kind, size, pattern in [("linear_scale", scale, scale * ref), *(("time_shift", float(j), np.roll(ref, j)) for j in (-2, -1, 1, 2))]:
                left_over = float(np.sum((b[:m] - pattern) ** 2) + np.sum((b[m:] - pattern.mean()) ** 2))
                best.append((kind, int(p), size, before + left_over, 3))
    kind, place, size, s, k = min(best, key=lambda c: n * math.log(max(c[3], 1e-12) / n) + 2 * c[4])
    if s >= s0:
        return none
    f = ((s0 - s) / k) / max(s / (n - k - 1), 1e-12)
    p = min(1.0, f_right_tail(f, k, n - k - 1) * len(at))
    return (kind, place, size, p) if p < CHANGE_SIGNIFICANT else none


def change_points(df: DataFrame, keys: list[str], bucket: str, value: str, span: int) -> DataFrame:
    """(keys, kind, bucket, size, p_value) of each series' most telling change, if significant."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x = regular(pdf, bucket, span)
        kind, place, size, p = detect_change(x - decompose_series(t, x, span)["season"]) if len(t) else ("none", -1, 0.0, 1.0)
        rows = [] if kind == "none" else [(kind, int(t[place]), size, p)]
        return pd.DataFrame(rows, columns=["kind", bucket, "size", "p_value"]).astype({"kind": str, bucket: "int64", "size": float, "p_value": float})

    return grouped(df, keys, bucket, value, f"kind string, `{bucket}` long, size double, p_value double", run)


def segment(x: np.ndarray, most: int = 8, p: float = 1e-3) -> list[int]:
    """Starts of a top-down piecewise-linear segmentation."""

    def cost(a: int, b: int) -> float:
        u = np.arange(b - a, dtype=float)
        c = np.polyfit(u, x[a:b], 1) if b - a > 2 else np.array([0.0, x[a:b].mean()])
        return float(np.sum((x[a:b] - np.polyval(c, u)) ** 2))

    cuts = [0]
    while len(cuts) < most:
        ends, best = [*cuts[1:], len(x)], None
        for a, b in zip(cuts, ends):
            if b - a < 16:
                continue
            whole = cost(a, b)
            for m in range(a + 6, b - 6, max(1, (b - a) // 48)):
                s = cost(a, m) + cost(m, b)
                f = ((whole - s) / 2) / max(s / max(b - a - 4, 1), 1e-12)
                q = f_right_tail(f, 2, max(b - a - 4, 1)) * (b - a)
                if best is None or q < best[0]:
                    best = (q, m)
        if best is None or best[0] > p:
            break
        cuts = sorted([*cuts, best[1]])
    return cuts


def segments(df: DataFrame, keys: list[str], bucket: str, value: str, span: int) -> DataFrame:
    """(keys, start, end, slope, level) of each straight piece."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x = regular(pdf, bucket, span)
        rows = []
        cuts = segment(x) if len(x) else []
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            slope, level = np.polyfit(np.arange(b - a), x[a:b], 1) if b - a > 1 else (0.0, x[a])
            rows.append((int(t[a]), int(t[b - 1]) + span, float(slope), float(level)))
        return pd.DataFrame(rows, columns=["start", "end", "slope", "level"]).astype({"start": "int64", "end": "int64", "slope": float, "level": float})

    return grouped(df, keys, bucket, value, "start long, end long, slope double, level double", run)


def forecast(df: DataFrame, keys: list[str], bucket: str, value: str, span: int, duration: int = DAY, z: float = 1.96, non_negative: bool = True) -> DataFrame:
    """(keys, bucket, lower, prediction, upper): no further ahead than the history is long; none from under 8 buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x = regular(pdf, bucket, span)
        columns = [bucket, "lower", "prediction", "upper"]
        if len(t) < 8:
            return pd.DataFrame({c: [] for c in columns}).astype({bucket: "int64"})
        d = decompose_series(t, x, span)
        ahead = t[-1] + span * np.arange(1, min(duration // span, len(t)) + 1)
        mid = trend_at(d["coefficients"], ahead, t[0], t[-1])
        for _, table in d["tables"]:
            mid = mid + table[(ahead // span) % len(table)]
        wide = z * d["rest"].std() * np.sqrt(1 + np.arange(1, len(ahead) + 1) / len(t))
        floor = 0.0 if non_negative and x.min() >= 0 else -np.inf
        return pd.DataFrame({bucket: ahead, "lower": np.maximum(mid - wide, floor), "prediction": np.maximum(mid, floor), "upper": np.maximum(mid + wide, floor)})

    return grouped(df, keys, bucket, value, f"`{bucket}` long, lower double, prediction double, upper double", run)


def lowess(t: np.ndarray, x: np.ndarray, share: float = 0.3) -> np.ndarray:
    """Locally weighted straight-line smooth."""
    n, k = len(x), max(3, int(share * len(x)))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(t - t[i])
        h = max(np.partition(d, min(k, n - 1))[min(k, n - 1)], 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        m = w > 0
        a = np.stack([np.ones(m.sum()), t[m] - t[i]], axis=1)
        out[i] = np.linalg.lstsq(a * w[m, None] ** 0.5, x[m] * w[m] ** 0.5, rcond=None)[0][0]
    return out


def calendar_test(df: DataFrame, feature: str, error: str, threshold: float) -> DataFrame:
    """(feature value, n, large): how many large errors fall on each value of a calendar feature."""
    return df.groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(error) > threshold).alias("large"))
