"""Combining probabilities up the result hierarchy, and normalising scores to 0-100."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import expressions as X
from driftwell.functions.special import beta_cdf, joint_less_likely, log_joint_of, two_sided_deviation
from driftwell.operators.windows import running_totals_by_value

LEVELS = ("root", "partition", "person")
CUTOFF = 0.035
INFLUENCE_CUTOFF = 0.4
# Percentile -> normalised score knots, (joint weight, extreme weight, least, most extreme samples), and the logs of
# the joint and extreme probabilities where scores end.
KNOTS = [(0.0, 0.0), (70.0, 1.0), (85.0, 1.2), (90.0, 1.5), (95.0, 3.0), (97.0, 20.0), (99.0, 50.0), (99.9, 90.0), (100.0, 100.0)]
FLOORS = (-100_000.0, -1500.0)
STYLES = {"people": (0.0, 1.0, 1, 1), "attributes": (0.5, 0.5, 1, 5), "detectors": (0.5, 0.5, 1, 1)}


def level_summaries(df: DataFrame, bucket: str, partition: str, person: str, probability: str) -> DataFrame:
    """(bucket, partition, person, level, n, least, extreme, score): one grouping-sets pass over all levels."""
    b, q, r = (F.col(c) for c in (bucket, partition, person))
    g = df.groupingSets([(b, q, r), (b, q), (b,)], b, q, r).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.min(probability).alias("least")
    )
    level = F.when(F.col("g") == 0, "person").when(F.col("g") == 1, "partition").otherwise("root")
    return (
        g.select(b.alias("bucket"), q.alias("partition"), r.alias("person"), "n", "least", level.alias("level"))
        .withColumn("extreme", X.extreme_probability("least", "n"))
        .withColumn("score", X.anomaly_score("extreme"))
    )


def written(levels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Those of level_summaries() that are reported: the node's or its least descendant's probability is below the cutoff."""
    return levels.where(F.least("least", "extreme") < cutoff)


def influencer_pivots(df: DataFrame, influencers: list[str], bucket: str, probability: str) -> DataFrame:
    """(bucket, influencer, influencer_value, n, least): results pivoted by influencer."""
    pairs = F.array(*[F.struct(F.lit(i).alias("influencer"), F.col(i).cast("string").alias("influencer_value")) for i in influencers])
    return (
        df.select(bucket, probability, F.explode(pairs).alias("i"))
        .where("i.influencer_value is not null")
        .groupBy(bucket, "i.influencer", "i.influencer_value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(probability).alias("least"))
    )


def joint_probability(probabilities: Column | str) -> Column:
    """Chance of a set of samples less likely than this array of two-sided probabilities."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: joint_less_likely(np.asarray(p)))

    return F.pandas_udf(run, "double")(X.col(probabilities))


def log_extreme(p: np.ndarray, n: int, least: int, most: int) -> float:
    """log of the smallest chance, over i in least..most, that the i-th smallest of n is as small as the i-th of p (ascending)."""
    best = 0.0
    for i in range(min(least, n), min(n, most) + 1):
        best = min(best, math.log(max(beta_cdf(max(p[i - 1], 1e-300), i, n - i + 1), X.TINY)) if i > 1 else log_least(p[0], n))
    return best


def log_least(p: float, n: int) -> float:
    """log of the chance that the least of n uniform probabilities is at most p."""
    if p >= 1:
        return 0.0
    return math.log(n) + math.log(max(p, 1e-300)) if n * p < 1e-12 else math.log(-math.expm1(n * math.log1p(-p)))


def score_of(p: float) -> float:
    p = max(p, X.TINY)
    if p >= X.UNUSUAL:
        return 0.0
    if p >= X.HIGH:
        return (1 / p - 20) / (1 / X.HIGH - 20)
    if p >= X.LOW:
        return 1 + 49 * (X.LOG_HIGH - math.log(p)) / (X.LOG_HIGH - X.LOG_LOW)
    return 50 + 50 * (X.LOG_LOW - math.log(p)) / (X.LOG_LOW - X.LOG_TINY)


def probability_of(score: float) -> float:
    """The inverse of score_of() for scores above zero."""
    if score <= 1:
        return 1 / (20 + score * (1 / X.HIGH - 20))
    if score <= 50:
        return math.exp(X.LOG_HIGH - (score - 1) / 49 * (X.LOG_HIGH - X.LOG_LOW))
    return math.exp(X.LOG_LOW - (min(score, 100.0) - 50) / 50 * (X.LOG_LOW - X.LOG_TINY))


def overall(log_joint: float, log_ext: float, style: str) -> tuple[float, float]:
    """(score, probability) from the logs of a set's joint and extreme probabilities under a style's weights.

    Both above the cutoff: score zero, probabilities weighted.  Otherwise four fifths of the score come from probabilities down
    to the least double; the last fifth from how far below that their logs lie, on the way to FLOORS.
    """
    weights = STYLES[style][:2]
    plain = math.exp(sum(w * v for w, v in zip(weights, (log_joint, log_ext))))
    if min(log_joint, log_ext) > math.log(CUTOFF):
        return 0.0, plain
    score = 0.0
    for weight, v, floor in zip(weights, (log_joint, log_ext), FLOORS):
        if v < X.LOG_TINY:
            score += weight * 100 * (0.8 + 0.2 * min((v - X.LOG_TINY) / (floor - X.LOG_TINY), 1.0))
        else:
            score += weight * 0.8 * score_of(math.exp(v))
    return score, probability_of(min(score / 0.8, 100.0)) if score > 0 else plain


def overall_score(p: np.ndarray, style: str) -> tuple[float, float]:
    """overall() of a set of probabilities; (0, 1) for none."""
    p = np.sort(np.clip(np.asarray(p, float), 1e-300, 1.0))
    if not len(p):
        return 0.0, 1.0
    z = two_sided_deviation(p)
    return overall(log_joint_of(len(p), float(z @ z), float(p[0])), log_extreme(p, len(p), *STYLES[style][2:]), style)


def deviation(probability: Column | str) -> Column:
    """How many standard deviations out a two-sided probability lies; null for null."""

    def run(p: pd.Series) -> pd.Series:
        return pd.Series(np.where(p.isna(), np.nan, two_sided_deviation(p.fillna(1.0).to_numpy(float))))

    return F.pandas_udf(run, "double")(X.col(probability))


def joint_of_sums(n: Column | str, squares: Column | str, least: Column | str) -> Column:
    """Joint probability of a set from its (weighted) size, its sum of squared deviations and its least member."""

    def run(n: pd.Series, m: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([math.exp(log_joint_of(*t)) for t in zip(n, m, p)], dtype=float)

    return F.pandas_udf(run, "double")(X.col(n).cast("double"), X.col(squares).cast("double"), X.col(least).cast("double"))


def combined(df: DataFrame, keys: list[str], probability: str, style: str = "detectors") -> DataFrame:
    """(keys, n, score, probability): joint and extreme probabilities over each key's results; null probabilities take no part.

    The joint part needs a size and a sum of squares, the extreme part a few least probabilities: both merge before the
    shuffle, so a key may hold any number of results.
    """
    least, most = STYLES[style][2:]

    def run(n: pd.Series, squares: pd.Series, p: pd.Series) -> pd.DataFrame:
        found = [overall(log_joint_of(k, m, q[0]), log_extreme(q, int(k), least, most), style) for k, m, q in zip(n, squares, p)]
        return pd.DataFrame(found, columns=["score", "probability"], dtype=float)

    rows = df.where(F.col(probability).isNotNull()).select(*keys, F.least(F.greatest(probability, F.lit(1e-300)), F.lit(1.0)).alias("_p"))
    sums = rows.withColumn("_z", deviation("_p")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("_m"))
    first = Window.partitionBy(*keys).orderBy("_p")
    few = rows.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_q"))
    match = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    out = sums.alias("s").join(few.alias("f"), match)
    r = F.pandas_udf(run, "score double, probability double")(F.col("n").cast("double"), F.col("_m"), F.col("_q"))
    return out.select(*[F.col(f"s.{k}") for k in keys], "n", r.alias("r")).select(*keys, "n", "r.score", "r.probability")


def features_combined(df: DataFrame, keys: list[str], probability: str, category: str | None = None) -> DataFrame:
    """(keys, n, joint, extreme, probability) of a detector's features: the smaller of their joint and extreme probabilities,
    then joined with the probability of the person's category where a column holds one (equal over a key's rows)."""
    p = F.least(F.greatest(probability, F.lit(1e-300)), F.lit(1.0))
    rows = df.where(F.col(probability).isNotNull()).select(*keys, p.alias("_p"), (F.col(category) if category else F.lit(None).cast("double")).alias("_c"))
    g = rows.withColumn("_z", deviation("_p")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("_m"), F.min("_p").alias("_l"), F.min("_c").alias("_c")
    )
    out = g.withColumn("joint", joint_of_sums("n", "_m", "_l")).withColumn("extreme", X.extreme_probability("_l", "n"))
    out = out.withColumn("probability", F.least("joint", "extreme"))
    if category:
        out = out.withColumn("probability", F.coalesce(pair_probability("probability", "_c"), F.col("probability")))
    return out.select(*keys, "n", "joint", "extreme", "probability")


def pair_probability(a: Column | str, b: Column | str) -> Column:
    """Joint probability of two; null where either is."""
    a, b = X.col(a), X.col(b)
    za, zb = deviation(a), deviation(b)
    # of two, the chi-squared tail is an exponential
    return F.exp(-(za * za + zb * zb) / 2)


def population_combined(df: DataFrame, keys: list[str], attribute: str, probability: str, category: str, weight: str | None = None) -> DataFrame:
    """(keys, n, probability) of a person in a bucket: each attribute's features combined and joined with the attribute's
    category probability, then the attributes joined, each counting by its weight (one without a weight column)."""
    w = df.groupBy(*keys, attribute).agg((F.max(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    each = features_combined(df, [*keys, attribute], probability, category).join(w, [*keys, attribute]).withColumn("_z", deviation("probability"))
    g = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_z") * F.col("_z")).alias("_m"), F.min("probability").alias("_l")
    )
    return g.select(*keys, "n", joint_of_sums("_n", "_m", "_l").alias("probability"))


def influence(log_all: Column, log_part: Column, kind: str) -> Column:
    """Influence 0..1: 'without' compares with the result without the influencer, 'only' with the influencer alone."""
    ratio = log_part / F.least(log_all, F.lit(-1e-12))
    raw = 1 - ratio if kind == "without" else ratio
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def interpolated(percentile: Column) -> Column:
    """Piecewise-linear interpolation of KNOTS."""
    out = F.lit(KNOTS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(KNOTS, KNOTS[1:]))):
        out = F.when(percentile <= x1, y0 + (percentile - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return out


def ranked(df: DataFrame, scope: list[str], score: str) -> DataFrame:
    """(scope, score, own, below, total, largest): of every distinct score, how many rows hold it, less than it, and in all.

    Equal scores are counted before anything is sorted, and running totals go range by range, so no task holds a whole scope.
    """
    keys = scope or ["_all"]
    rows = df.where(F.col(score).isNotNull()) if scope else df.where(F.col(score).isNotNull()).withColumn("_all", F.lit(0))
    counts = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("own"))
    out = running_totals_by_value(counts, keys, score, ["own"], one_key=not scope).withColumn("below", F.col("own_upto") - F.col("own"))
    whole = counts.groupBy(*keys).agg(F.sum("own").alias("total"), F.max(score).alias("largest"))
    return out.join(whole if scope else F.broadcast(whole), keys).select(*scope, score, "own", "below", "total", "largest")


def normalise(df: DataFrame, scope: list[str], score: str) -> DataFrame:
    """df with normalised (0-100): the least of the percentile's knot value and the ratio to the scope's largest score."""
    r = ranked(df, scope, score)
    rank = F.when(F.col("total") > 1, 100 * F.col("below") / (F.col("total") - 1)).otherwise(0.0)
    ratio = F.col(score) / F.col("largest")
    cap = 100 * F.least(1.5 * ratio, 0.5 + 0.5 * ratio)
    table = r.select(*scope, score, F.when(F.col(score) <= 0, 0.0).otherwise(F.least(interpolated(rank), cap)).alias("normalised"))
    return df.join(table, [*scope, score], "left").select(*df.columns, "normalised")


def ceilings(df: DataFrame, scope: list[str], score: str, noise: float = 50.0) -> DataFrame:
    """df with normalised (0-100): the least of four ceilings; zero stays zero.

    How far the score stands above the noise percentile, the knots at the shares of scores below it and at most it, the ratio
    to the scope's largest score, and its probability on a log scale.  Shares are exact, so no interval is put around them.
    """
    r = ranked(df, scope, score)
    s, share = F.col(score), lambda c: 100 * c / F.col("total")
    floor = r.where(F.col("below") + F.col("own") >= F.col("total") * noise / 100).groupBy(*scope).agg(F.min(score).alias("_noise"))
    zero = r.groupBy(*scope).agg((F.sum(F.when(s <= 0, F.col("own")).otherwise(0)) / F.max("total")).alias("_zero"))
    knot = next(y for x, y in KNOTS if x >= noise)
    r = (r.join(floor, scope).join(zero, scope) if scope else r.crossJoin(F.broadcast(floor)).crossJoin(F.broadcast(zero)))  # one row each
    fade = 100 * F.greatest(2 * F.least(100 * F.col("_zero") / noise, F.lit(1.0)) - 1, F.lit(0.0))
    by_noise = knot * F.greatest(1 + 10 * (s - F.col("_noise")), F.lit(0.0)) + fade
    by_share = (interpolated(share(F.col("below"))) + interpolated(share(F.col("below") + F.col("own")))) / 2
    ratio = s / F.col("largest")
    slope = 1 / (X.LOG_HIGH - math.log(X.UNUSUAL))
    by_log = 100 * (0.95 * slope * (F.log(X.probability_of_score(s)) - math.log(X.UNUSUAL)) + 0.05)
    least = F.least(by_noise, by_share, 100 * F.least(1.5 * ratio, 0.5 + 0.5 * ratio), by_log, F.lit(100.0))
    table = r.select(*scope, score, F.when(s <= 0, 0.0).otherwise(least).alias("normalised"))
    return df.join(table, [*scope, score], "left").select(*df.columns, "normalised")


def equalised(df: DataFrame, detector: str, probability: str) -> DataFrame:
    """df with equalised: each detector's probabilities mapped by their own quantiles to uniform ones."""
    w = Window.partitionBy(detector).orderBy(probability)
    return df.withColumn("equalised", F.cume_dist().over(w))


def category_probability(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, category, n, probability): share of events in categories at most as frequent, ties included."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = w.orderBy("n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("probability", F.sum("n").over(upto) / F.sum("n").over(w))


def shannon_entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, entropy) in bits."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    # sum n log n needs one pass: H = log N - sum(n log n) / N
    return counts.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
