"""Column expressions: time, scores, tails, rounding.  All stay inside whole-stage code generation."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308  # smallest normal double
HIGH, LOW = 1e-4, 1e-50  # score bands' probabilities
UNUSUAL = 0.05
LOG_HIGH, LOG_LOW, LOG_TINY = math.log(HIGH), math.log(LOW), math.log(TINY)
DAY, WEEK = 86_400, 604_800
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def parse_duration(text: str | int | float) -> int:
    """Whole seconds of a duration such as '15m', '1h', '2d' or plain seconds; ValueError if it isn't one."""
    if isinstance(text, (int, float)):
        return int(text)
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d|w)?\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(int(m[1]) * UNITS[m[2] or "s"])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (session time zone UTC)."""
    return F.unix_timestamp(col(ts).cast("timestamp"))


def bucket_of(ts: Column | str, span: int) -> Column:
    """Start of the half-open bucket [start, start + span) that holds ts, in epoch seconds."""
    return (F.floor(epoch(ts) / F.lit(span)) * span).cast("long")


def time_of_day(ts: Column | str) -> Column:
    return F.pmod(epoch(ts), F.lit(DAY))


def time_of_week(ts: Column | str) -> Column:
    return F.pmod(epoch(ts), F.lit(WEEK))


def anomaly_score(p: Column | str) -> Column:
    """0 to 100 for a probability: zero from 0.05 up, then linear in 1/p, then linear in log p in two bands."""
    q = F.greatest(col(p), F.lit(TINY))
    return (
        F.when(q >= UNUSUAL, 0.0)
        .when(q >= HIGH, (1 / q - 1 / UNUSUAL) / (1 / HIGH - 1 / UNUSUAL))
        .when(q >= LOW, 1 + 49 * (LOG_HIGH - F.log(q)) / (LOG_HIGH - LOG_LOW))
        .otherwise(50 + 50 * (LOG_LOW - F.log(q)) / (LOG_LOW - LOG_TINY))
    )


def probability_of_score(score: Column | str) -> Column:
    """The inverse of anomaly_score(); 0.525, the middle of its flat part, for zero."""
    s = col(score)
    return (
        F.when(s <= 0, (1 + UNUSUAL) / 2)
        .when(s <= 1, 1 / (1 / UNUSUAL + s * (1 / HIGH - 1 / UNUSUAL)))
        .when(s <= 50, F.exp(LOG_HIGH - (s - 1) / 49 * (LOG_HIGH - LOG_LOW)))
        .otherwise(F.exp(LOG_LOW - (F.least(s, F.lit(100.0)) - 50) / 50 * (LOG_LOW - LOG_TINY)))
    )


def severity(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 75, "critical").when(s >= 50, "major").when(s >= 25, "minor").otherwise("warning")


def extreme_probability(least: Column | str, n: Column | str) -> Column:
    """Chance that the smallest of n uniform probabilities is at most `least`."""
    return -F.expm1(col(n) * F.log1p(-F.least(col(least), F.lit(1 - 1e-16))))


def multibucket_impact(log_single: Column | str, log_multi: Column | str) -> Column:
    """How much more the several-bucket than the single-bucket log probability weighs: -5 to 5, floored to hundredths."""
    s, m = F.least(col(log_single), F.lit(-0.001)), F.least(col(log_multi), F.lit(-0.001))
    raw = 5 * F.least(s, m) / F.least(F.greatest(s, m), F.lit(-0.001)) / math.log(1000) * (s - m)
    return F.floor(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), raw)) * 100) / 100


def completeness(count: Column | str, expected: Column | str) -> Column:
    """Share of an unfinished bucket's expected events that are in: 0 to 1, 1 where none is expected."""
    return F.when(col(expected) <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(count) / col(expected))))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    return F.sum(col(value) * col(weight)) / F.sum(col(weight))


def new_cluster_probability(age: Column | str, period: float) -> Column:
    """exp(-(t / period)^4): how likely a new time-of-day or time-of-week cluster still is."""
    return F.exp(-F.pow(col(age) / period, 4))


def calendar_features(ts: Column | str) -> dict[str, Column]:
    """Day of month, days before its end, which weekday of the month, and which before the end."""
    d = F.to_date(col(ts))
    day, left = F.dayofmonth(d), F.datediff(F.last_day(d), d)
    return {
        "day_of_month": day,
        "days_before_end": left,
        "day_of_week": F.dayofweek(d) - 1,
        "nth_weekday": F.floor((day - 1) / 7).cast("int") + 1,
        "nth_weekday_before_end": F.floor(left / 7).cast("int"),
    }


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def normalise_space(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(c)), r"\s+", " ")


def logistic(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def fuzzy_above(value: Column | str, threshold: float, width: float) -> Column:
    """Degree 0 to 1 to which a value is above a threshold: a half there, steeper the smaller the width."""
    return 1 / (1 + F.exp(-(col(value) - threshold) / width))


def fuzzy_and(*truths: Column) -> Column:
    out = F.lit(1.0)
    for t in truths:
        out = out * t
    return out


def fuzzy_or(*truths: Column) -> Column:
    out = F.lit(1.0)
    for t in truths:
        out = out * (1 - t)
    return 1 - out
