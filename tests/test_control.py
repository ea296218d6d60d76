"""A replayed stream with each control message."""

import pytest
from pyspark.sql import functions as F

from driftwell.streaming import control as C

SPAN = 60


def fed(steps, latency=0, how="count"):
    """The results of a shard's rows: (time, person[, value]) or a message."""
    shard = C.Shard(SPAN, latency, how, 0.0005)
    for s in steps:
        if isinstance(s, str):
            shard.message(s)
        else:
            shard.record(s[0], "", s[1], s[2] if len(s) > 2 else 1.0)
    return [(o[0], o[1], o[3], o[4]) for o in shard.out]


def test_buckets_close_in_order_and_empty_ones_count():
    got = fed([(0, "a"), (5, "a"), (10, "b"), (200, "a"), (260, "c")])
    assert got == [("result", 0, "a", 2), ("result", 0, "b", 1), ("result", 60, "a", 0), ("result", 60, "b", 0), ("result", 120, "a", 0), ("result", 120, "b", 0), ("result", 180, "a", 1), ("result", 180, "b", 0)]
    assert fed([(0, "a", 3.0), (30, "a", 5.0), (130, "a", 1.0)], how="mean") == [("result", 0, "a", 4.0)]
    assert fed([(0, "a", 3.0), (30, "a", 5.0), (130, "a", 1.0)], how="sum") == [("result", 0, "a", 8.0), ("result", 60, "a", 0.0)]


def test_late_rows_within_the_latency():
    assert fed([(0, "a"), (70, "a"), (50, "a"), (120, "a")], latency=60) == [("result", 0, "a", 2)]
    assert fed([(0, "a"), (70, "a"), (50, "a"), (130, "b")]) == [("result", 0, "a", 1), ("result", 60, "a", 1)]


def test_interim_results_are_not_final():
    assert fed([(0, "a"), "i", (30, "a"), "i", (60, "a")]) == [("interim", 0, "a", 1), ("interim", 0, "a", 2), ("result", 0, "a", 2)]
    assert fed([(0, "a"), (70, "a"), "i 60 120"], latency=600) == [("interim", 60, "a", 1)]


def test_reset_forgets_open_buckets():
    assert fed([(0, "a"), (30, "a"), "r 0 60", (40, "a"), (60, "b")]) == [("result", 0, "a", 1)]


def test_skip_leaves_no_results_in_between():
    got = fed([(0, "a"), (65, "a"), "s 300", (305, "a"), (360, "a")])
    assert got == [("result", 0, "a", 1), ("result", 300, "a", 1)]


def test_advance_and_flush():
    assert fed([(0, "a"), "t 120", "f id7"]) == [("result", 0, "a", 1), ("result", 60, "a", 0), ("flush", 120, None, None)]
    assert fed(["f id7", "t 100", "s 100", "r 0 60", "x unknown", "", "t nonsense"]) == []


def test_stream(spark, tmp_path):
    schema = "seq long, t long, partition string, person string, value double, message string"
    parts = [
        [(1, 0, "", "a", 1.0, None), (2, 10, "", "b", 1.0, None), (3, 20, None, "a", 1.0, None)],
        [(4, 30, None, None, None, "i"), (5, 70, "", "a", 1.0, None)],
        [(6, 130, None, None, None, "t 130")],
        [(7, 140, "", "a", 1.0, None), (8, 141, None, None, None, "r 120 180"), (9, 150, "", "a", 1.0, None), (10, 150, None, None, None, "f last")],
        [(11, 400, "", "z", 1.0, None)],
        [(12, 401, "", "z", 1.0, None)],
    ]
    base = 6000  # a record at the epoch itself would be late to a stream's first watermark
    for p in parts:
        p = [(n, t + base, *r, m.replace("130", "6130").replace("120 180", "6120 6180") if m else m) for n, t, *r, m in p]
        spark.createDataFrame(p, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = C.controlled_job(stream, SPAN, shards=4).writeStream.format("memory").queryName("controlled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    got = [(r["kind"], r["bucket"] - base, r["person"], r["actual"]) for r in spark.table("controlled").collect()]
    finals = {r[1:3]: r[3] for r in got if r[0] == "result"}
    assert finals[0, "a"] == 2 and finals[0, "b"] == 1 and finals[60, "a"] == 1 and finals[60, "b"] == 0
    # the timer closes what no later record of the shard did
    assert finals[120, "a"] == 1 and finals[120, "b"] == 0 and finals[180, "b"] == 0
    assert {r[1:] for r in got if r[0] == "interim"} >= {(0, "a", 2.0), (0, "b", 1.0)} and any(r[0] == "flush" for r in got)


def test_unknown_value(spark):
    with pytest.raises(ValueError):
        C.controlled_job(spark.range(1), 60, how="median")
