"""Series models with forgetting under control: recovery after a shift, states across runs and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import series as S


def planted(n=1200, shift=700, seed=1, by=30.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 3600
    x = 50 + 10 * np.sin(2 * np.pi * t / 86400) + rng.normal(0, 1, n)
    x[shift:] += by
    return t, x


def recovery(t, x, shift, controlled):
    """Buckets from the shift until 20 in a row lie within the interval, and half its width there."""
    _, rows = S.learned(None, t, x, 3600, 0.0005, controlled)
    inside = [lo <= v <= hi and hi - lo < 60 for _, v, _, lo, hi, _, _ in rows]
    typical = [abs(v - m) < 5 for _, v, m, *_ in rows]
    return next((i - shift for i in range(shift, len(rows) - 20) if all(inside[i : i + 20]) and all(typical[i : i + 20])), len(rows))


def test_controlled_forgetting_recovers_sooner():
    t, x = planted()
    assert recovery(t, x, 700, True) < 0.5 * recovery(t, x, 700, False)


def test_quiet_series_do_not_forget_faster():
    t, x = planted(by=0.0)
    _, rows = S.learned(None, t, x, 3600, 0.0005, True)
    assert max(r[-1] for r in rows[-100:]) <= 1.5
    assert np.mean([lo <= v <= hi for _, v, _, lo, hi, _, _ in rows[300:]]) > 0.9


def test_a_spike_is_unlikely_and_the_season_is_known():
    t, x = planted(by=0.0)
    x[1000] += 40
    _, rows = S.learned(None, t, x, 3600, 0.0005, True)
    assert min(range(400, 1200), key=lambda i: rows[i][5]) == 1000 and rows[1000][5] < 1e-6
    assert np.mean([abs(r[2] - v) for r, v in zip(rows[600:], x[600:])]) < 2


def frame(spark, t, x):
    rows = [("a", int(i), float(v)) for i, v in zip(t, x)] + [(None, int(i), float(-v)) for i, v in zip(t[:300], x[:300])] + [("a", None, 1.0), ("a", 5, None), ("b", 0, math.nan)]
    return spark.createDataFrame(rows, "k string, bucket long, v double").repartition(3)


def collected(df):
    return {(r["k"], r["bucket"]): tuple(r)[2:] for r in df.collect()}


def test_slices_and_runs_go_on_from_the_states(spark):
    t, x = planted(500, 300)
    df = frame(spark, t, x)
    whole, _ = S.series_scores(df, ["k"], "bucket", "v", 3600)
    want = collected(whole)
    assert len(want) == 800 and want["a", int(t[-1])] == pytest.approx(S.learned(None, t, x, 3600, 0.0005, True)[1][-1][1:])
    sliced, _ = S.series_scores(df, ["k"], "bucket", "v", 3600, slice_buckets=130)
    assert collected(sliced) == want
    first, states = S.series_scores(df.where(F.col("bucket") < t[200]), ["k"], "bucket", "v", 3600)
    second, last = S.series_scores(df.where(F.col("bucket") >= t[150]), ["k"], "bucket", "v", 3600, states=states)
    assert collected(first) | collected(second) == want and last.count() == 2


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "k string, bucket long, v double")
    scored, states = S.series_scores(none, ["k"], "bucket", "v", 3600)
    assert scored.count() == 0 == states.count()


def test_stream(spark, tmp_path):
    t, x = planted(90, 60)
    rows = spark.createDataFrame([("", "a", int(i), float(v)) for i, v in zip(t, x)], "partition string, person string, bucket long, value double")
    for a in (0, 30, 60):
        rows.where((F.col("bucket") >= int(t[a])) & (F.col("bucket") < int(t[a]) + 30 * 3600)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.stream_series(stream, 3600).writeStream.format("memory").queryName("series").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["bucket"], r["typical"]) for r in spark.table("series").collect())
    want = [(r[0], r[2]) for r in S.learned(None, t, x, 3600, 0.0005, True)[1]]
    assert [b for b, _ in got] == [b for b, _ in want] and [m for _, m in got] == pytest.approx([m for _, m in want])
