"""Detectors over streams: watermarked bucket features and stateful models per key."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.operators.features import aggregate_of
from driftwell.plans.config import Detector


def stream_features(stream: DataFrame, d: Detector, time: str, span: int, latency: int) -> DataFrame:
    """(bucket, partition, person, value), final once the watermark (latency behind) passes the bucket's end.

    Only functions that one aggregation makes: not the rare family, zero filling or compressed lengths.
    Distinct counts are approximate on streams, as exact ones have no mergeable state of fixed size.
    """
    spec = d.spec
    if spec.value in ("rare", "rare_count", "freq_rare", "freq_rare_count", "info_content", "median"):
        raise ValueError(f"{d.function} is not a streaming aggregate")
    who = d.over or d.by
    rows = stream.select(
        F.col(time).cast("timestamp").alias("_ts"),
        (F.coalesce(F.col(d.partition).cast("string"), F.lit("")) if d.partition else F.lit("")).alias("partition"),
        (F.col(who).cast("string") if who else F.lit("")).alias("person"),
        *([F.col(d.field_name).alias("_field")] if d.field_name else []),
    ).where("_ts is not null and person is not null")
    rows = rows.withColumn("_day", F.pmod(F.unix_timestamp("_ts"), F.lit(86_400))).withColumn("_week", F.pmod(F.unix_timestamp("_ts"), F.lit(604_800)))
    value = F.approx_count_distinct("_field") if spec.value == "distinct" else aggregate_of(spec.value, "_field" if d.field_name else None, None)
    return (
        rows.withWatermark("_ts", f"{latency} seconds")
        .groupBy(F.window("_ts", f"{span} seconds").alias("w"), "partition", "person")
        .agg(value.alias("value"))
        .select(F.unix_timestamp("w.start").alias("bucket"), "partition", "person", "value")
    )


def update_model(state: tuple[float, float, float], x: float, rate: float) -> tuple[tuple[float, float, float], float, float]:
    """((n, mean, m2), typical, z) after learning x."""
    n, mean, m2 = state
    keep = math.exp(-rate)
    n, m2 = n * keep + 1, m2 * keep
    d = x - mean
    mean += d / n
    m2 += d * (x - mean)
    spread = math.sqrt(max(m2 / n, 1e-12))
    return (n, mean, m2), mean, (x - mean) / spread if n > 2 else 0.0


def stream_scores(values: DataFrame, rate: float = 0.0005, prune: str | None = None) -> DataFrame:
    """(partition, person, bucket, actual, typical, z): each bucket value against its key's running model.

    State is three numbers a key in the state store; with `prune`, a key unseen for so long is dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else (0.0, 0.0, 0.0)
        rows = []
        for pdf in frames:
            for b, v in sorted(zip(pdf["bucket"], pdf["value"])):
                held, typical, z = update_model(held, float(v), rate)
                rows.append((*key, int(b), float(v), typical, z))
        state.update(held)
        if prune:
            state.setTimeoutDuration(int(prune))
        yield pd.DataFrame(rows, columns=["partition", "person", "bucket", "actual", "typical", "z"])

    return values.groupBy("partition", "person").applyInPandasWithState(
        run,
        "partition string, person string, bucket long, actual double, typical double, z double",
        "n double, mean double, m2 double",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if prune else GroupStateTimeout.NoTimeout,
    )


def control_message(text: str) -> tuple[str, dict]:
    """The meaning of a control message: its first character, and what follows."""
    kinds = {" ": "fill", ".": "header", "f": "flush", "i": "interim_results", "r": "reset_buckets", "s": "skip_time", "t": "advance_time", "u": "update_config", "p": "forecast", "w": "persist", "z": "refresh"}
    if not text or text[0] not in kinds:
        raise ValueError(f"unknown control message {text[:20]!r}")
    kind, rest = kinds[text[0]], text[1:].strip()
    if kind in ("skip_time", "advance_time"):
        return kind, {"time": int(rest)}
    if kind in ("interim_results", "reset_buckets") and rest:
        start, _, end = rest.partition(" ")
        return kind, {"start": int(start), "end": int(end or start)}
    if kind in ("update_config", "forecast") and rest.startswith("{"):
        return kind, json.loads(rest)
    return kind, {"text": rest} if rest else {}
