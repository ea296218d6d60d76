"""The anomaly job from events to documents, on planted data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import hierarchy
from driftwell.plans import job as J
from driftwell.plans.config import Condition, Detector, JobConfig, Rule

HOURS = 24 * 12


def events(spark, upto=HOURS, since=0):
    rng = np.random.default_rng(9)
    rows = []
    for h in range(HOURS):
        for who in "abc":
            n = int(rng.poisson(20 + 8 * np.sin(2 * np.pi * h / 24))) + (90 if (who, h) == ("b", 250) else 0)
            rows += [(h * 3600 + int(rng.integers(0, 3600)), who, "east" if who != "c" else "west", f"u{int(u)}", float(v)) for u, v in zip(rng.integers(0, 8, n), rng.normal(5, 1, n))]
    rows.append((260 * 3600, "a", "east", "u1", 400.0))
    rows = [r for r in rows if since <= r[0] < upto * 3600]
    return spark.createDataFrame(rows, "t long, who string, region string, user string, v double").withColumn("ts", F.timestamp_seconds("t")).repartition(4)


JOB = JobConfig((Detector("high_count", by="who", partition="region"), Detector("max", "v", by="who", partition="region")), bucket_span=3600, time_field="ts")


@pytest.fixture(scope="module")
def results(spark):
    return J.run(events(spark), JOB)


def test_planted_anomalies_lead_every_level(results):
    records = sorted(results.written_records().collect(), key=lambda r: r["probability"])
    assert {(r["detector"], r["bucket"] // 3600, r["person"]) for r in records[:2]} == {(0, 250, "b"), (1, 260, "a")}
    assert len(records) < 0.1 * results.records.count()
    for level in ("root", "partition", "person"):
        top = sorted((r for r in results.nodes.where(F.col("level") == level).collect()), key=lambda r: -r["score"])[:2]
        assert {r["bucket"] // 3600 for r in top} == {250, 260}
    assert all(0 <= r["normalised"] <= 100 for r in results.nodes.select("normalised").collect())


def test_each_level_combines_the_one_below(results):
    rows = [r for r in results.records.collect() if r["bucket"] == 250 * 3600]
    nodes = {(r["level"], r["partition"], r["person"]): r for r in results.nodes.where(F.col("bucket") == 250 * 3600).collect()}
    own = [r["probability"] for r in rows if r["person"] == "b"]
    assert nodes["person", "east", "b"]["probability"] == pytest.approx(hierarchy.overall_score(own, "detectors")[1], rel=1e-6)
    people = [r["probability"] for k, r in nodes.items() if k[:2] == ("person", "east")]
    assert nodes["partition", "east", None]["score"] == pytest.approx(hierarchy.overall_score(people, "people")[0], rel=1e-6)
    parts = [r["probability"] for k, r in nodes.items() if k[0] == "partition"]
    assert nodes["root", None, None]["score"] == pytest.approx(hierarchy.overall_score(parts, "attributes")[0], rel=1e-6)


def test_documents(results):
    docs = [json.loads(r["document"]) for r in results.documents(3600).collect()]
    buckets = {d["bucket"]["timestamp"]: d["bucket"] for d in docs if "bucket" in d}
    assert 250 * 3600 in buckets and buckets[250 * 3600]["record_count"] == sum("record" in d and d["record"]["bucket"] == 250 * 3600 for d in docs)


def test_a_later_run_goes_on_from_the_states(spark, results):
    first = J.run(events(spark, upto=200), JOB)
    second = J.run(events(spark, since=200 * 3600), JOB, first.states)
    key = lambda rows: {(r["detector"], r["bucket"], r["person"]): r["probability"] for r in rows.collect()}
    both = key(first.records) | key(second.records)
    whole = key(results.records)
    assert both.keys() == whole.keys() and all(both[k] == pytest.approx(whole[k]) for k in whole)


def test_population_and_rules(spark):
    skip = Rule(("skip_result",), (Condition("actual", "lt", 100.0),))
    job = JobConfig((Detector("max", "v", by="who", over="user"), Detector("max", "v", by="who", partition="region", rules=(skip,))), bucket_span=3600, time_field="ts")
    out = J.run(events(spark), job)
    least = min(out.records.collect(), key=lambda r: r["probability"])
    assert (least["detector"], least["bucket"], least["person"], least["attribute"]) in ((0, 260 * 3600, "u1", "a"), (1, 260 * 3600, "a", ""))
    assert {(r["bucket"], r["person"]) for r in out.records.where("detector = 1").collect()} == {(260 * 3600, "a")}
    with pytest.raises(ValueError):
        J.run(events(spark), JobConfig((Detector("rare", by="who"),), time_field="ts"))
