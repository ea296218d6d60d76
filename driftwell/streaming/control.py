"""A job on a stream of records and control messages: buckets, models, interim and final results, in keyed state.

Persons are dealt to shards, whose state holds their open buckets and models; every message reaches all shards.  Within a
shard rows are taken in their order.  A bucket is final once time has passed its end by the latency: by a later record, an
advance message, or the watermark, for which the state sets a timer; then every person known so far gets a result, zero
where nothing came (means: none), and its model learns.

Messages, as control_message() reads them: flush gives an acknowledgement with its text from each shard that knows anybody;
interim_results gives results of open buckets (of a range, if stated) that are neither final nor learned; reset_buckets
forgets what open buckets of a range hold, so that it can be sent again; skip_time drops what is open before a time and goes on
from it, without results in between; advance_time lets time pass.  Others change nothing here.

Rows: records without a time, person or (but for counts) value are left out, as are those of buckets that are final; a null partition
is the empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.operators.series import Series, fresh
from driftwell.streaming.jobs import control_message

SCHEMA = "kind string, bucket long, partition string, person string, actual double, typical double, probability double, text string"


class Shard:
    """The state of a shard: the first bucket that isn't final, open buckets' counts and sums, models by person."""

    def __init__(self, span: int, latency: int, how: str, rate: float):
        self.span, self.latency, self.how, self.rate = span, latency, how, rate
        self.next: int | None = None
        self.open: dict[int, dict[tuple[str, str], list[float]]] = {}
        self.models: dict[tuple[str, str], np.ndarray] = {}
        self.out: list[tuple] = []

    def value(self, held: list[float] | None) -> float | None:
        n, total = held or (0.0, 0.0)
        return n if self.how == "count" else total if self.how == "sum" else total / n if n else None

    def results(self, bucket: int, kind: str) -> None:
        """A result for every person known in the bucket; final ones are learned."""
        own = self.open.get(bucket, {})
        for who in sorted(self.models.keys() | own.keys()):
            x = self.value(own.get(who))
            if x is None:
                continue
            model = Series(self.models.get(who, fresh()), self.span, self.rate, True)
            typical, _, _, p, _ = model.learn(bucket, x)
            if kind == "result":
                self.models[who] = model.state()
            self.out.append((kind, bucket, *who, x, typical, p, None))

    def pass_to(self, time: int) -> None:
        """Time has come this far: buckets that ended the latency before it are final."""
        while self.next is not None and self.next + self.span + self.latency <= time:
            if not self.models and not self.open:
                self.next = None
                return
            self.results(self.next, "result")
            self.open.pop(self.next, None)
            self.next += self.span

    def record(self, time: int, partition: str, person: str, value: float | None) -> None:
        bucket = time // self.span * self.span
        if self.next is None:
            self.next = bucket
        # what comes early in a stream may belong to a bucket before the first seen, as long as none is final
        if bucket < self.next and not self.models and self.next - bucket <= self.latency:
            self.next = bucket
        if bucket >= self.next:
            held = self.open.setdefault(bucket, {}).setdefault((partition, person), [0.0, 0.0])
            held[0] += 1
            held[1] += value or 0.0
        self.pass_to(time)

    def message(self, text: str) -> None:
        try:
            kind, rest = control_message(text)
        except (ValueError, TypeError):
            return
        start, end = rest.get("start", -(1 << 62)), rest.get("end", 1 << 62)
        if kind == "advance_time":
            self.pass_to(rest["time"])
        elif kind == "skip_time" and self.next is not None:
            upto = rest["time"] // self.span * self.span
            self.open = {b: held for b, held in self.open.items() if b >= upto}
            self.next = max(self.next, upto)
        elif kind == "reset_buckets":
            self.open = {b: held for b, held in self.open.items() if not start <= b < max(end, start + 1)}
        elif kind == "interim_results":
            for b in sorted(self.open):
                if start <= b < max(end, start + 1):
                    self.results(b, "interim")
        elif kind == "flush" and (self.models or self.open):
            self.out.append(("flush", self.next, None, None, None, None, None, rest.get("text", "")))


def controlled_job(stream: DataFrame, span: int, latency: int = 0, how: str = "count", rate: float = 0.0005, shards: int = 256) -> DataFrame:
    """SCHEMA: results of a stream (seq long, ts timestamp, partition, person, value, message).

    seq orders rows and messages of a micro-batch; a row with a message is one, whatever its other columns hold, but needs a
    ts for the watermark.
    """
    if how not in ("count", "sum", "mean"):
        raise ValueError(how)
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.xxhash64(F.coalesce("partition", F.lit("")), "person"), F.lit(shards)).cast("int"))
    rows = (
        stream.withWatermark("ts", f"{latency} seconds")
        .where("ts is not null and (message is not null or person is not null)")
        .select(F.explode(F.when(F.col("message").isNotNull(), everywhere).otherwise(own)).alias("shard"), "seq", "ts", F.unix_timestamp("ts").alias("t"), F.coalesce("partition", F.lit("")).alias("partition"), "person", F.col("value").cast("double").alias("value"), "message")
    )

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = Shard(span, latency, how, rate)
        if state.exists:
            shard.next, shard.open, shard.models = pickle.loads(state.get[0])
        if state.hasTimedOut:
            shard.pass_to(state.getCurrentWatermarkMs() // 1000 + latency)
        else:
            for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
                if isinstance(r.message, str):
                    shard.message(r.message)
                elif how == "count" or r.value == r.value:
                    shard.record(int(r.t), r.partition, r.person, None if r.value != r.value else r.value)
        state.update((pickle.dumps((shard.next, shard.open, shard.models)),))
        if shard.next is not None and (shard.models or shard.open):
            due = 1000 * (shard.next + span)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(shard.out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("shard").applyInPandasWithState(run, SCHEMA, "s binary", "append", GroupStateTimeout.EventTimeTimeout)
