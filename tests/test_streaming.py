"""Streams give what the same rows give in a batch."""

import pytest
from pyspark.sql import functions as F

from driftwell.operators import features
from driftwell.plans.config import Detector
from driftwell.streaming import jobs


def source(spark, tmp_path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "t long, who string, v double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("t long, who string, v double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


ROWS = [[(0, "a", 1.0), (10, "a", 3.0), (20, "b", 2.0)], [(70, "a", 5.0), (75, "b", 1.0)], [(130, "a", 7.0), (500, "z", 0.0)], [(1000, "z", 0.0)]]


def test_bucket_features_match_the_batch(spark, tmp_path):
    stream = source(spark, tmp_path, ROWS)
    d = Detector("mean", "v", by="who")
    drain(jobs.stream_features(stream, d, "ts", 60, 0), "feat", tmp_path)
    got = {(r["bucket"], r["person"]): r["value"] for r in spark.table("feat").collect()}
    batch = features.feature_values(spark.read.parquet(str(tmp_path / "in")), d, "ts", 60).collect()
    want = {(r["bucket"], r["person"]): r["value"] for r in batch}
    assert got and all(want[k] == v for k, v in got.items()) and {k for k in want if k[0] < 480} <= set(got)


def test_running_model_keeps_state(spark, tmp_path):
    stream = source(spark, tmp_path, ROWS).select(F.lit("").alias("partition"), F.col("who").alias("person"), (F.col("t") - F.col("t") % 60).alias("bucket"), F.col("v").alias("value"))
    drain(jobs.stream_scores(stream), "scores", tmp_path)
    rows = spark.table("scores").collect()
    assert len(rows) == 8 and {r["person"] for r in rows} == {"a", "b", "z"}


def test_rare_is_no_stream(spark):
    with pytest.raises(ValueError):
        jobs.stream_features(spark.range(1), Detector("rare", by="x"), "ts", 60, 0)
