"""A model of each series as a fixed set of numbers a key, whose forgetting follows its own errors.

The state holds a level, a mean offset for each phase of a day, a normal law of what these leave, and running errors.  Errors that
grow, shrink or lean to one side say that the series has changed: the rate of forgetting then rises, and falls
back when they settle.  A batch goes through time in slices: each slice's rows meet their keys' states, and the new states are
a table that the next slice, or a later run, goes on from; a stream keeps the same numbers in its state store.  So no
group holds a series, and nothing is learned twice.

Rows: buckets without a value or with a null bucket change nothing and give no row; a null key is a key; several rows of a
key and bucket are learned in order of value; a bucket not later than what a key has learned is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.functions.special import t_two_sided
from driftwell.sources.tables import dropped, written

DAY, PHASES = 86_400, 24
# Thresholds, rates and bounds of the control of forgetting.
FASTER, SLOW, FAST = 1.2, 5.0, 25.0
GROWING, SHRINKING, SETTLED, LEANING, LEVEL = 2.0, 1.5, 1.2, 0.5, 0.3
LEAST_MULTIPLIER, MOST_MULTIPLIER, LEAST_BUCKETS = 0.2, 40.0, 336.0

NAMES = ("last", "level_n", "level", "rest_n", "rest_mean", "rest_m2", "errors_n", "bias", "recent", "history", "target", "smooth_n", "smooth")


def fresh() -> np.ndarray:
    """The state of a key that nothing is known of: NAMES, then counts and means of the phases."""
    s = np.zeros(len(NAMES) + 2 * PHASES)
    s[0] = -math.inf
    s[NAMES.index("target")] = s[NAMES.index("smooth_n")] = s[NAMES.index("smooth")] = 1.0
    return s


class Series:
    """The model over its state: learn() takes buckets in order of time."""

    def __init__(self, state: np.ndarray, span: int, rate: float, controlled: bool):
        self.v = dict(zip(NAMES, state.tolist()))
        self.phase_n, self.phase = state[len(NAMES) : len(NAMES) + PHASES].copy(), state[len(NAMES) + PHASES :].copy()
        self.span, self.rate, self.controlled = span, rate, controlled

    def state(self) -> np.ndarray:
        return np.concatenate([[self.v[n] for n in NAMES], self.phase_n, self.phase])

    def predicted(self, t: int) -> float:
        return self.v["level"] + self.phase[t % DAY * PHASES // DAY]

    def spread(self) -> float:
        v = self.v
        return math.sqrt(v["rest_m2"] / v["rest_n"]) if v["rest_n"] > 1 else math.inf

    def learn(self, t: int, x: float) -> tuple[float, float, float, float, float]:
        """(typical, lower, upper, probability, multiplier) before x, which is then learned."""
        v = self.v
        typical, s, n = self.predicted(t), self.spread(), v["rest_n"]
        error = x - typical if v["level_n"] else 0.0
        known = n > 2 and math.isfinite(s)
        width = 2 * s if known else math.inf
        p = t_two_sided((error - v["rest_mean"]) / (max(s, 1e-9 * (1 + abs(typical))) * math.sqrt(1 + 1 / n)), max(n - 1, 1)) if known else 1.0
        multiplier = self.control(error) if self.controlled and v["level_n"] else 1.0
        keep = math.exp(-self.rate * multiplier)
        for name in ("level_n", "rest_n", "rest_m2"):
            v[name] *= keep
        self.phase_n *= keep
        if v["level_n"] > 0:
            v["rest_n"] += 1
            d = error - v["rest_mean"]
            v["rest_mean"] += d / v["rest_n"]
            v["rest_m2"] += d * (error - v["rest_mean"])
        k = t % DAY * PHASES // DAY
        v["level_n"] += 1
        v["level"] += (x - self.phase[k] - v["level"]) / v["level_n"]
        self.phase_n[k] += 1
        self.phase[k] += (x - v["level"] - self.phase[k]) / (self.phase_n[k] + 1)
        v["last"] = float(t)
        return typical, typical - width, typical + width, p, multiplier

    def control(self, error: float) -> float:
        """What the rate of forgetting is multiplied by, after this error."""
        v = self.v
        before = v["smooth"]
        # means that forget at two speeds: of the error, of its size lately, and of its size in the long run
        n = v["errors_n"] = v["errors_n"] + 1
        slow, fast = (max(1 / n, 1 - math.exp(-f * self.rate * before)) for f in (SLOW, FAST))
        v["bias"] += fast * (error - v["bias"])
        v["recent"] += fast * (abs(error) - v["recent"])
        v["history"] += slow * (abs(error) - v["history"])
        if n <= 0.0005 * LEAST_BUCKETS / self.rate or v["history"] <= 1e-4 * abs(v["level"]):
            return before
        bias, recent, history = abs(v["bias"]), v["recent"], v["history"]
        step = FASTER ** min(self.span / 1800, 1.0)
        if recent > GROWING * history or history > SHRINKING * recent or bias > LEANING * recent:
            change = step
        elif recent < SETTLED * history and history < SETTLED * recent and bias < LEVEL * recent:
            change = 1 / step
        else:
            change = 1.0
        most = MOST_MULTIPLIER / (1 + min(max((self.span - 1800) / DAY, 0.0), 1.0))
        v["target"] = min(max(v["target"] * change, LEAST_MULTIPLIER), most)
        v["smooth_n"] = v["smooth_n"] * math.exp(-before * self.rate * SLOW) + 1
        v["smooth"] += max(1 / v["smooth_n"], 0.1) * (v["target"] - v["smooth"])
        return v["smooth"]


RESULT = "actual double, typical double, lower double, upper double, probability double, multiplier double"


def learned(state: bytes | None, buckets, values, span: int, rate: float, controlled: bool) -> tuple[bytes, list[tuple]]:
    """The new state, and (bucket, actual, typical, lower, upper, probability, multiplier) of each bucket learned."""
    model = Series(np.frombuffer(state, float) if state else fresh(), span, rate, controlled)
    since, rows = model.v["last"], []
    for t, x in sorted((int(t), float(x)) for t, x in zip(buckets, values) if t == t and x == x and t is not None and x is not None):
        if t > since:
            rows.append((t, x, *model.learn(t, x)))
    return model.state().tobytes(), rows


def series_scores(
    df: DataFrame, keys: list[str], bucket: str, value: str, span: int, rate: float = 0.0005, controlled: bool = True,
    states: DataFrame | None = None, slice_buckets: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """((keys, bucket, actual, typical, lower, upper, probability, multiplier), (keys, state)).

    states: those of an earlier run to go on from.  The second table is what a later run goes on from; write it to keep it.
    """
    kinds = dict(df.dtypes)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(bucket).cast("long").alias("t"), F.col(value).cast("double").alias("x"))
    rows = rows.where(F.col("t").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    key_schema = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys))
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    held = states.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "state") if states is not None else df.sparkSession.createDataFrame([], f"{key_schema}, state binary")
    first, last = (ends["a"], ends["b"]) if ends["a"] is not None else (0, -1)

    def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        state, out = learned(bytes(old["state"].iloc[0]) if len(old) else None, new["t"], new["x"], span, rate, controlled)
        columns = ["t", "actual", "typical", "lower", "upper", "probability", "multiplier"]
        pdf = pd.DataFrame([*out, (None,) * 7], columns=columns)
        pdf["state"] = [None] * len(out) + [state]
        for n, k in zip(names, key):
            pdf[n] = k
        return pdf[[*names, *columns, "state"]]

    schema = f"{key_schema}, t long, {RESULT}, state binary"
    parts, before = [], None
    for at in range(first, last + 1, span * slice_buckets):
        part = rows.where((F.col("t") >= at) & (F.col("t") < at + span * slice_buckets))
        # a row with the state besides those of the buckets; keys without rows keep theirs
        parts.append(written(part.groupBy(*names).cogroup(held.groupBy(*names)).applyInPandas(run, schema)))
        held = parts[-1].where("state is not null").select(*names, "state")
    if not parts:
        parts.append(written(held.select(*names, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in f"t long, {RESULT}".split(", ")], "state")))
        held = parts[-1].select(*names, "state")
    scored = written(*[p.where("state is null").drop("state") for p in parts])
    kept = written(held)
    dropped(*parts)
    named = [F.col(n).alias(k) for n, k in zip(names, keys)]
    return scored.select(*named, F.col("t").alias(bucket), *[c.split()[0] for c in RESULT.split(", ")]), kept.select(*named, "state")


def stream_series(values: DataFrame, span: int, rate: float = 0.0005, controlled: bool = True) -> DataFrame:
    """series_scores() of a stream (partition, person, bucket, value), with the state in the state store."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames))
        new, rows = learned(bytes(state.get[0]) if state.exists else None, pdf["bucket"], pdf["value"], span, rate, controlled)
        state.update((new,))
        yield pd.DataFrame([(*key, *r) for r in rows], columns=["partition", "person", "bucket", *[c.split()[0] for c in RESULT.split(", ")]])

    return values.groupBy("partition", "person").applyInPandasWithState(
        run, f"partition string, person string, bucket long, {RESULT}", "state binary", "append", GroupStateTimeout.NoTimeout
    )
