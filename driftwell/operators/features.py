"""Detector functions: one value per bucket, partition and person (and attribute, in a population).

A "person" is the by value of an individual detector or the over value of a population detector, whose by
value is the attribute.  Detectors with the same keys share one aggregation.  Nulls: a row without its
person is skipped (unless use_null, which makes it ""); a null partition is ""; a null value takes no part
in metric statistics.  With a summary count, a null count marks an explicit null (never
zero-filled), a count is rounded half up, and zero or unreadable counts drop the row.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import expressions as X
from driftwell.plans.config import Detector


def deflated_length(values: list[str]) -> int:
    """Bytes of the compressed concatenation of sorted distinct values."""
    z = zlib.compressobj()
    return sum(len(z.compress(v.encode("utf-8"))) for v in sorted(set(values))) + len(z.flush())


def info_content(values: Column) -> Column:
    """Compressed length of every row's array of strings."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: deflated_length(list(v)))

    return F.pandas_udf(run, "long")(values)


def aggregate_of(kind: str, field: str | None, weight: Column | None) -> Column:
    """The aggregate that makes a bucket's value."""
    v = F.col(field).cast("double") if field and kind not in ("distinct", "info_content", "lat_long") else None
    if kind == "count":
        return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")
    if kind == "distinct":
        return F.count_distinct(F.col(field))
    if kind == "info_content":
        return F.array_sort(F.collect_set(F.col(field).cast("string")))
    if kind == "time_of_day":
        return F.avg("_day").cast("long")
    if kind == "time_of_week":
        return F.avg("_week").cast("long")
    if kind == "metric":
        return F.struct(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    if kind == "mean":
        return F.avg(v) if weight is None else F.sum(v * weight) / F.sum(F.when(v.isNotNull(), weight))
    if kind == "median":
        return F.median(v)
    if kind == "varp":
        return F.when(F.count(v) >= 2, F.var_pop(v))
    if kind == "lat_long":
        at = lambda i: F.try_element_at(F.split(F.col(field), ","), F.lit(i)).try_cast("double")
        ok = at(1).isNotNull() & at(2).isNotNull()
        return F.struct(F.avg(F.when(ok, at(1))).alias("lat"), F.avg(F.when(ok, at(2))).alias("lon"))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](v)


def prepared(df: DataFrame, d: Detector, time: str, span: int, summary_count: str | None = None) -> DataFrame:
    """Rows that the detector reads, with bucket, partition, person, attribute, field columns and weight."""
    named = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if d.use_null else F.col(c).cast("string")) if c else F.lit("")
    person, attribute = (d.over, d.by) if d.over else (d.by, None)
    ts = X.epoch(time)
    columns = [
        X.bucket_of(time, span).alias("bucket"),
        (F.coalesce(F.col(d.partition).cast("string"), F.lit("")) if d.partition else F.lit("")).alias("partition"),
        named(person).alias("person"),
        named(attribute).alias("attribute"),
        F.pmod(ts, F.lit(X.DAY)).alias("_day"),
        F.pmod(ts, F.lit(X.WEEK)).alias("_week"),
        ts.alias("_time"),
    ]
    if d.field_name:
        columns.append(F.col(d.field_name).alias("_field"))
    if d.spec.value == "lat_long":
        # split once a row, not once an aggregate
        columns.append(F.transform(F.split(F.col(d.field_name), ",", 3), lambda s: s.try_cast("double")).alias("_place"))
    if summary_count:
        text = F.col(summary_count).cast("string")
        columns += [
            (text.isNull() | text.isin("", "null")).alias("_explicit_null"),
            F.floor(text.try_cast("double") + 0.5).cast("long").alias("_weight"),
        ]
    out = df.where(F.col(time).isNotNull()).select(*columns).where("person is not null")
    if summary_count:
        out = out.where("_explicit_null or _weight > 0")
    return out


def feature_values(df: DataFrame, d: Detector, time: str, span: int, summary_count: str | None = None) -> DataFrame:
    """(bucket, partition, person, attribute, value) of a detector, with zero-filled buckets where its function asks."""
    spec = d.spec
    rows = prepared(df, d, time, span, summary_count)
    keys = ["bucket", "partition", "person", "attribute"]
    if spec.value.startswith(("rare", "freq_rare")):
        return rarity(rows, spec.value, bool(d.over), spec.name)
    weight = F.when(~F.col("_explicit_null"), F.col("_weight")) if summary_count else None
    real = rows.where("not _explicit_null") if summary_count else rows
    if d.over:
        real = real.where("attribute is not null")
    if spec.value == "lat_long":
        real = real.withColumn("_lat", F.get("_place", 0)).withColumn("_lon", F.get("_place", 1)).where("_lat is not null and _lon is not null")
        value = F.struct(F.avg("_lat").alias("lat"), F.avg("_lon").alias("lon"))
    else:
        value = aggregate_of(spec.value, "_field" if d.field_name else None, weight)
    out = real.groupBy(*keys).agg(value.alias("value"))
    if spec.value == "info_content":
        out = out.withColumn("value", info_content("value"))
    elif spec.value not in ("count", "distinct"):
        out = out.where(F.col("value.mean" if spec.value == "metric" else "value.lat" if spec.value == "lat_long" else "value").isNotNull())
    if spec.zero_fill and not d.over:
        nulls = rows.where("_explicit_null").select("bucket", "partition", "person").distinct() if summary_count else None
        out = zero_fill(out, rows.select("bucket", "partition", "person"), span, nulls)
    return out.select(*keys, "value")


def zero_fill(values: DataFrame, seen: DataFrame, span: int, explicit_nulls: DataFrame | None = None) -> DataFrame:
    """Zero for every bucket from a person's first up to the last bucket of all; not where only explicit nulls stand."""
    known = seen.groupBy("partition", "person").agg(F.min("bucket").alias("first"))
    end = seen.agg(F.max("bucket").alias("end"))
    grid = known.crossJoin(F.broadcast(end)).select(  # one row on the right
        "partition", "person", F.explode(F.sequence("first", "end", F.lit(span).cast("long"))).alias("bucket")
    )
    zero = F.lit(0).cast(values.schema["value"].dataType)
    filled = grid.join(values, ["bucket", "partition", "person"], "left")
    if explicit_nulls is not None:
        marks = explicit_nulls.withColumn("_null", F.lit(True))
        filled = filled.join(marks, ["bucket", "partition", "person"], "left").where("value is not null or _null is null")
    return filled.select("bucket", "partition", "person", F.coalesce("attribute", F.lit("")).alias("attribute"), F.coalesce("value", zero).alias("value"))


def rarity(rows: DataFrame, kind: str, population: bool, name: str) -> DataFrame:
    """How rare: buckets with the person (individual) or distinct persons with the attribute (population), and counts."""
    keys = ["bucket", "partition", "person", "attribute"]
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not population:
        known = per.groupBy("partition", "person").agg(F.count_distinct("bucket").alias("value"))
        out = per.join(known, ["partition", "person"])
        return out.select(*keys, "value", *(["n"] if name == "rare_non_zero_count" else []))
    persons = per.groupBy("partition", "attribute").agg(F.count_distinct("person").alias("persons"))
    if kind in ("rare", "rare_count"):
        out = per.join(persons, ["partition", "attribute"]).withColumnRenamed("persons", "value")
        return out.select(*keys, "value", *(["n"] if kind == "rare_count" else []))
    totals = per.groupBy("partition", "person", "attribute").agg(F.sum("n").alias("total"))
    out = per.join(persons, ["partition", "attribute"]).join(totals, ["partition", "person", "attribute"])
    return out.select(*keys, F.col("persons").alias("value"), "total", *(["n"] if kind == "freq_rare_count" else []))


def running_rarity(rows: DataFrame) -> DataFrame:
    """(bucket, partition, person, seen): in how many buckets up to this one the person has been seen."""
    w = Window.partitionBy("partition", "person").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("bucket", "partition", "person").distinct().withColumn("seen", F.count(F.lit(1)).over(w))


def shared_features(df: DataFrame, detectors: list[Detector], time: str, span: int) -> DataFrame:
    """One aggregation for detectors with the same keys: (bucket, partition, person, attribute, d0, d1, ...)."""
    keys = {(d.by, d.over, d.partition, d.use_null) for d in detectors}
    if len(keys) != 1:
        raise ValueError("detectors must share by, over and partition fields")
    if any(d.spec.value.startswith(("rare", "freq_rare")) for d in detectors):
        raise ValueError("rare functions have an aggregation of their own")
    first = detectors[0]
    names = sorted({d.field_name for d in detectors if d.field_name})
    both = df.where(F.col(time).isNotNull()).select(
        X.bucket_of(time, span).alias("bucket"),
        (F.coalesce(F.col(first.partition).cast("string"), F.lit("")) if first.partition else F.lit("")).alias("partition"),
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if first.use_null else F.col(c).cast("string")).alias(a) if c else F.lit("").alias(a)
          for a, c in (("person", first.over or first.by), ("attribute", first.by if first.over else None))],
        X.time_of_day(time).alias("_day"),
        X.time_of_week(time).alias("_week"),
        *[F.col(n).alias(f"_f{i}") for i, n in enumerate(names)],
    ).where("person is not null" + (" and attribute is not null" if first.over else ""))
    return both.groupBy("bucket", "partition", "person", "attribute").agg(
        *[aggregate_of(d.spec.value, f"_f{names.index(d.field_name)}" if d.field_name else None, None).alias(f"d{i}") for i, d in enumerate(detectors)]
    )


def fixed_count_samples(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Means of every n consecutive measurements of a key: (keys, sample, value, count)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("sample", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
        .groupBy(*keys, "sample")
        .agg(F.avg(value).alias("value"), F.count(value).alias("count"))
    )


def influences(df: DataFrame, d: Detector, influencers: list[str], time: str, span: int) -> DataFrame:
    """(bucket, partition, person, influencer, influencer_value, value): the detector's value by influencer, one row each."""
    spec, field = d.spec, d.field_name
    who = d.over or d.by
    return (
        df.select(
            X.bucket_of(time, span).alias("bucket"),
            (F.coalesce(F.col(d.partition).cast("string"), F.lit("")) if d.partition else F.lit("")).alias("partition"),
            (F.col(who).cast("string") if who else F.lit("")).alias("person"),
            F.explode(F.array(*[F.struct(F.lit(i).alias("influencer"), F.col(i).cast("string").alias("influencer_value")) for i in influencers])).alias("i"),
            *([F.col(field).alias("_field")] if field else []),
        )
        .where("person is not null and i.influencer_value is not null")
        .groupBy("bucket", "partition", "person", "i.influencer", "i.influencer_value")
        .agg(aggregate_of(spec.value, "_field" if field else None, None).alias("value"))
    )


def prune_persons(values: DataFrame, window: int) -> DataFrame:
    """Values of persons seen (with a nonzero value) within the last `window` seconds before the last bucket of all."""
    last = values.where("value <> 0").groupBy("partition", "person").agg(F.max("bucket").alias("_last"))
    end = values.agg(F.max("bucket").alias("_end"))
    kept = last.crossJoin(F.broadcast(end)).where(F.col("_last") >= F.col("_end") - window).select("partition", "person")  # one row
    return values.join(kept, ["partition", "person"], "left_semi")


# Functions whose values start at one, so that models hold them less one.
FROM_ONE = {"non_zero_count", "distinct_count", "info_content", "rare"}


def modelled(value: Column | str, function: str) -> Column:
    """The value as models hold it: less one for counts that can't be zero."""
    return X.col(value) - (1 if plain(function) in FROM_ONE else 0)


def displayed(value: Column | str, function: str) -> Column:
    """A modelled value or prediction as it is shown: the offset put back, and no count below zero."""
    shown = X.col(value) + (1 if plain(function) in FROM_ONE else 0)
    return F.greatest(shown, F.lit(0.0)) if plain(function) in FROM_ONE | {"count", "rare_count"} else shown


def plain(function: str) -> str:
    """A function's name without its side."""
    return function.split("_", 1)[1] if function.startswith(("low_", "high_")) else function


def sample_times(df: DataFrame, d: Detector, time: str, span: int) -> DataFrame:
    """(bucket, partition, person, attribute, time): when a bucket's value counts as measured, in epoch seconds.

    The middle of the bucket for counts and sums; the mean time of the measurements for sampled metrics.
    """
    sampled = d.spec.value in ("mean", "median", "min", "max", "varp", "metric", "lat_long") and "sum" not in d.spec.name
    rows = prepared(df, d, time, span)
    keys = ["bucket", "partition", "person", "attribute"]
    if not sampled:
        return rows.select(*keys).distinct().withColumn("time", F.col("bucket") + span / 2)
    return rows.where("_field is not null").groupBy(*keys).agg(F.avg("_time").alias("time"))


def whole_buckets(df: DataFrame, time: str, span: int, latency: int = 0, restored: bool = False) -> DataFrame:
    """Rows from the first bucket's start on: the first time's bucket, less the latency; a restored job skips that bucket,
    of which it has seen a part only."""
    first = df.agg(F.min(X.epoch(time)).alias("_t")).select((F.floor(F.col("_t") / span) * span - latency + (span if restored else 0)).alias("_start"))
    return df.crossJoin(F.broadcast(first)).where(X.epoch(time) >= F.col("_start")).drop("_start")  # one row
