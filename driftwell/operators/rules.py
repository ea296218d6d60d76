"""Rules, filters, scheduled events, frequent values: which rows a detector reads and which results it keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.plans.config import Condition, Rule

OPERATORS = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
ACTIONS = {"skip_result": 1, "skip_model_update": 2, "force_time_shift": 4}


def late_rows(df: DataFrame, time: Column, last_end: int) -> DataFrame:
    """Rows not before the end of the last finished bucket."""
    return df.where(time >= last_end)


def condition(c: Condition, actual: Column, typical: Column, time: Column) -> Column:
    value = {"actual": actual, "typical": typical, "diff_from_typical": F.abs(actual - typical), "time": time}[c.applies_to]
    return getattr(value, OPERATORS[c.operator])(c.value)


def matches_patterns(c: Column, patterns: list[str]) -> Column:
    """Whether a string is one of: exact, prefix*, *suffix, *inner* (a bare * matches all)."""
    exact, tests = [], []
    for p in patterns:
        if p in ("*", "**"):
            tests.append(c.isNotNull())
        elif p.startswith("*") and p.endswith("*"):
            tests.append(c.contains(p[1:-1]))
        elif p.endswith("*"):
            tests.append(c.startswith(p[:-1]))
        elif p.startswith("*"):
            tests.append(c.endswith(p[1:]))
        else:
            exact.append(p)
    out = c.isin(exact) if exact else F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def rule_holds(rule: Rule, actual: Column, typical: Column, time: Column) -> Column:
    """All conditions hold and every scoped field is in (or, for exclude, outside) its filter."""
    out = F.lit(True)
    for c in rule.conditions:
        out = out & condition(c, actual, typical, time)
    for name, (kind, patterns) in rule.scope.items():
        inside = matches_patterns(F.col(name).cast("string"), list(patterns))
        out = out & (inside if kind == "include" else ~inside)
    return F.coalesce(out, F.lit(False))


def apply_rules(df: DataFrame, rules: list[Rule], actual: str, typical: str, time: str) -> DataFrame:
    """df with skip_result and skip_model_update."""
    out = df
    for action in ("skip_result", "skip_model_update"):
        flag = F.lit(False)
        for r in rules:
            if action in r.actions:
                flag = flag | rule_holds(r, F.col(actual), F.col(typical), F.col(time))
        out = out.withColumn(action, flag)
    return out


def in_filter(df: DataFrame, column: str, items: DataFrame, item: str, include: bool = True) -> DataFrame:
    """Semi or anti join with a filter table; Spark picks the join from its size."""
    return df.join(items.select(F.col(item).alias("_item")).distinct(), F.col(column) == F.col("_item"), "left_semi" if include else "left_anti")


def scheduled(df: DataFrame, bucket: str, events: list[tuple[str, int, int]]) -> DataFrame:
    """df with in_event: whether a scheduled (name, start, end) covers the bucket; the calendar is part of the job."""
    hit = F.lit(None).cast("string")
    for name, start, end in reversed(events):
        hit = F.when((F.col(bucket) >= start) & (F.col(bucket) < end), F.lit(name)).otherwise(hit)
    return df.withColumn("in_event", hit)


def exclude_frequent(df: DataFrame, within: list[str], value: str, threshold: float = 0.1) -> DataFrame:
    """Rows whose value makes up no more than the threshold's share of its group's rows."""
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(*within)) if within else None
    if share is None:
        total = counts.agg(F.sum("_n").alias("_total"))
        rare = counts.crossJoin(F.broadcast(total)).where(F.col("_n") <= threshold * F.col("_total"))  # one row
    else:
        rare = counts.withColumn("_share", share).where(F.col("_share") <= threshold)
    keys = [*within, value]
    rare = rare.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(rare, on, "left_semi")


def top_records(df: DataFrame, bucket: str, probability: str, n: int, ties: list[str]) -> DataFrame:
    """The n least likely records of each bucket, with their rank."""
    w = Window.partitionBy(bucket).orderBy(probability, *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def strip_matches(c: Column, patterns: list[str]) -> Column:
    """Text without the matches of any of the patterns."""
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c
