"""Special functions and tests in numpy, for use inside tasks."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution function, by bisection on erfc and Newton steps."""
    if p <= 0:
        return -38.5
    if p >= 1:
        return 38.5
    if p > 0.5:
        return -normal_quantile(1 - p)
    lo, hi = -38.5, 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    return math.exp(log_gamma_upper(a, x))


def log_gamma_upper(a: float, x: float) -> float:
    """log of the regularised upper incomplete gamma function, also far out where the function itself is no double."""
    if x <= 0:
        return 0.0
    front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return math.log(max(1e-300, 1 - total * math.exp(front)))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front + math.log(h)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, freedom: float) -> float:
    return beta_cdf(freedom / (freedom + t * t), freedom / 2, 0.5)


def f_right_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def f_left_tail(f: float, d1: float, d2: float) -> float:
    return 1 - f_right_tail(f, d1, d2)


def ks_two_sample(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance of two samples, and its asymptotic significance."""
    x, y = np.sort(x), np.sort(y)
    both = np.concatenate([x, y])
    d = float(np.max(np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y))))
    n = math.sqrt(len(x) * len(y) / (len(x) + len(y)))
    lam = (n + 0.12 + 0.11 / n) * d
    if lam < 0.2:
        return d, 1.0
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return d, min(1.0, max(0.0, p))


def cramer_von_mises(x: np.ndarray, cdf) -> float:
    """The statistic of one sample against a distribution function."""
    x = np.sort(x)
    i = np.arange(1, len(x) + 1)
    return float(1 / (12 * len(x)) + np.sum((cdf(x) - (2 * i - 1) / (2 * len(x))) ** 2))


def two_sided_deviation(p: np.ndarray) -> np.ndarray:
    """How many standard deviations out these two-sided probabilities lie."""
    inverse = NormalDist().inv_cdf
    return np.array([-inverse(max(x, 1e-300) / 2) if x < 1 else 0.0 for x in np.asarray(p, float).tolist()], float)


def log_joint_of(n: float, squares: float, least: float) -> float:
    """log of the joint probability of n (weighted) samples with this sum of squared deviations; one sample keeps its own."""
    if n <= 0 or squares / n < 1e-8:
        return 0.0
    return math.log(max(least, 1e-300)) if n == 1 else log_gamma_upper(n / 2, squares / 2)


def joint_less_likely(p: np.ndarray, correlation: float = 0.0) -> float:
    """Chance of a set of samples less likely than one with these two-sided probabilities (chi-squared)."""
    p = np.clip(np.asarray(p, float), 1e-300, 1.0)
    n = len(p)
    if n == 0:
        return 1.0
    if n == 1:
        return float(p[0])
    z = two_sided_deviation(p)
    total = float(np.sum(z * z))
    if correlation > 0 and total / n >= 1e-8:
        total = (total - correlation * z.sum() ** 2 / (n * correlation + 1 - correlation)) / (1 - correlation)
    return math.exp(log_joint_of(n, total, float(p.min())))


def dirichlet_smoothed(counts: np.ndarray, concentration: float = 1.0) -> np.ndarray:
    counts = np.asarray(counts, float)
    return (counts + concentration / len(counts)) / (counts.sum() + concentration)
