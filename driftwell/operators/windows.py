"""Window-shaped features over buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import expressions as X


def multibucket_mean(df: DataFrame, keys: list[str], bucket: str, value: str, length: int = 12) -> DataFrame:
    """df with multi_mean: mean of the last `length` buckets."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(1 - length, 0)
    return df.withColumn("multi_mean", F.avg(value).over(w))


def inter_arrival(df: DataFrame, keys: list[str], time: str, ties: list[str]) -> DataFrame:
    """df with gap: seconds since the key's row before; null for its first."""
    w = Window.partitionBy(*keys).orderBy(time, *ties)
    return df.withColumn("gap", X.epoch(time) - F.lag(X.epoch(time)).over(w))


def decayed_sum(df: DataFrame, keys: list[str], bucket: str, value: str, rate: float, span: int) -> DataFrame:
    """(keys, decayed): the sum of a key's values, aged by exp(-rate * buckets before the key's last)."""
    last = df.groupBy(*keys).agg(F.max(bucket).alias("_last"))
    age = (F.col("_last") - F.col(bucket)) / span
    return df.join(last, keys).groupBy(*keys).agg(F.sum(F.col(value) * F.exp(-rate * age)).alias("decayed"))


def expanding_window(df: DataFrame, keys: list[str], bucket: str, value: str, span: int, capacity: int) -> DataFrame:
    """(keys, start, mean, count): at most `capacity` buckets a key, their length doubled until the key's whole range fits."""
    reach = df.groupBy(*keys).agg(F.min(bucket).alias("_first"), F.max(bucket).alias("_last"))
    buckets = (F.col("_last") - F.col("_first")) / span + 1
    doublings = F.ceil(F.log2(F.greatest(F.lit(1.0), buckets / capacity)))
    width = (span * F.pow(F.lit(2.0), doublings)).cast("long")
    return (
        df.join(reach, keys)
        .withColumn("start", (F.col("_first") + F.floor((F.col(bucket) - F.col("_first")) / width) * width).cast("long"))
        .groupBy(*keys, "start")
        .agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    )


def running_totals(df: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(value).over(w)).withColumn("buckets_so_far", F.count(F.lit(1)).over(w))


def trailing_score(df: DataFrame, keys: list[str], bucket: str, value: str, tail: str = "two_sided", history: int = 24) -> DataFrame:
    """df with typical, probability and score of each value against the mean and spread of the buckets before it."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(-history, -1)
    out = (
        df.withColumn("typical", F.avg(value).over(w))
        .withColumn("spread", F.stddev_samp(value).over(w))
        .withColumn("z", (F.col(value) - F.col("typical")) / F.greatest(F.col("spread"), F.lit(1e-3)))
    )
    # two-sided normal tail through exp: Abramowitz-Stegun 7.1.26, error below 2e-7
    x = F.abs(F.col("z")) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    both = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    one = {"high": F.col("z") > 0, "low": F.col("z") < 0}.get(tail, F.lit(True))
    p = F.when(F.col("z").isNull(), 1.0).when(one, F.greatest(both, F.lit(X.TINY)) if tail == "two_sided" else F.greatest(both / 2, F.lit(X.TINY))).otherwise(0.5)
    return out.withColumn("probability", p).withColumn("score", X.anomaly_score("probability"))


def autocorrelation(df: DataFrame, keys: list[str], bucket: str, value: str, lag: int) -> DataFrame:
    """(keys, autocorrelation): correlation of a key's values with those `lag` rows before."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    return df.withColumn("_before", F.lag(value, lag).over(w)).where("_before is not null").groupBy(*keys).agg(F.corr(value, "_before").alias("autocorrelation"))


def seasonal_means(df: DataFrame, keys: list[str], bucket: str, value: str, period: int) -> DataFrame:
    """(keys, phase, mean, count): the mean of each phase of the period."""
    return df.groupBy(*keys, F.pmod(bucket, F.lit(period)).alias("phase")).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))


def week_part_means(df: DataFrame, keys: list[str], bucket: str, value: str, period: int) -> DataFrame:
    """(keys, weekend, phase, mean, count): seasonal_means() of weekdays and weekends (Saturday and Sunday, UTC) apart."""
    day = F.pmod(F.floor(F.col(bucket) / 86400) + 3, F.lit(7))  # Monday is 0
    return seasonal_means(df.withColumn("weekend", day >= 5), [*keys, "weekend"], bucket, value, period)


def seasonal_variance(df: DataFrame, keys: list[str], bucket: str, value: str, period: int) -> DataFrame:
    """(keys, rows, phases, variance, residual_variance, f): how much of a key's variance the means of a period's phases explain.

    f compares what the phases explain with what they leave, each by its degrees of freedom; null where nothing is left to compare.
    Rows meet in one aggregation by phase; the rest is on phases.
    """
    known = df.where(F.col(value).isNotNull())
    inside = known.groupBy(*keys, F.pmod(bucket, F.lit(period)).alias("_phase")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), (F.count(F.lit(1)) * F.var_pop(value)).alias("_left")
    )
    whole = Window.partitionBy(*keys)
    centre = F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.sum("_n").over(whole)
    between = inside.withColumn("_between", F.col("_n") * (F.col("_mean") - centre) ** 2)
    sums = between.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("phases"), F.sum("_between").alias("_b"), F.sum("_left").alias("_l"))
    f = (F.col("_b") / (F.col("phases") - 1)) / (F.col("_l") / (F.col("rows") - F.col("phases")))
    fine = (F.col("phases") > 1) & (F.col("rows") > F.col("phases")) & (F.col("_l") > 0)
    return sums.select(
        *keys, "rows", "phases", ((F.col("_b") + F.col("_l")) / F.col("rows")).alias("variance"), (F.col("_l") / F.col("rows")).alias("residual_variance"), F.when(fine, f).alias("f")
    )


def running_totals_by_value(counts: DataFrame, keys: list[str], value: str, columns: list[str], ranges: int = 256, one_key: bool = False) -> DataFrame:
    """counts, one row a (keys, value), with {column}_upto: the column's total over the key's values up to this one.

    one_key: the keys hold one value alone, so that what is known of its ranges goes to every task.

    A key's values are cut at approximate quantiles; each range sums its own rows in order and starts from the totals of the
    ranges before it.  A task holds a range, and only a key's few range totals meet in one window.  Results are exact wherever
    the cuts lie.
    """
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("_edges"))
    known = F.broadcast if one_key else (lambda df: df)
    cut = counts.join(known(edges), keys).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(upto), F.lit(0)).alias(f"_{c}_start") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(known(starts), [*keys, "_range"]).select(
        *counts.columns, *[(F.col(f"_{c}_start") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in columns]
    )
