"""The model of a population against the same laws fed value by value in plain Python."""

import math

import numpy as np
import pytest

from driftwell.operators import models as M


def plain(rows, rate):
    """(attribute, bucket, person) -> (typical, probability): laws by bucket, each learned from all its values at once."""
    out = {}
    for key in {r[0] for r in rows}:
        laws, logs = [M.NormalModel(), M.LogNormalModel(), M.GammaModel()], np.zeros(3)
        for t in sorted({r[1] for r in rows if r[0] == key}):
            own = [r for r in rows if r[0] == key and r[1] == t]
            for m in laws:
                m.age(math.exp(-rate))
            logs = logs * math.exp(-rate) + [sum(max(m.log_density(r[3]), -50.0) for r in own) for m in laws]
            for m in laws:
                for r in own:
                    m.add(r[3])
            w = np.exp(logs - logs.max())
            w /= w.sum()
            for r in own:
                both = np.array([m.tails(r[3]) for m in laws])
                out[r[:3]] = laws[0].mean, M.probability(tuple(w @ both), "two_sided")
    return out


@pytest.mark.parametrize("rate", [0.0, 0.05])
def test_as_fed_value_by_value(spark, rate):
    rng = np.random.default_rng(7)
    rows = [("a", t, f"p{i}", float(rng.gamma(3, 10))) for t in range(0, 500, 100) for i in range(40)] + [("b", t, "q", float(t)) for t in (0, 100, 200)]
    rows.append(("a", 300, "odd", 900.0))
    df = spark.createDataFrame(rows + [("a", 0, "none", None)], "attribute string, bucket long, person string, value double").repartition(4)
    got = {(r["attribute"], r["bucket"], r["person"]): r for r in M.population_scores(df, ["attribute"], "bucket", "value", rate=rate).collect()}
    want = plain(rows, rate)
    assert got.keys() == want.keys()
    for k, (typical, p) in want.items():
        assert got[k]["typical"] == pytest.approx(typical) and got[k]["probability"] == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert min(got, key=lambda k: got[k]["probability"]) == ("a", 300, "odd")


def test_empty(spark):
    assert M.population_scores(spark.createDataFrame([], "attribute string, bucket long, value double"), ["attribute"], "bucket", "value").count() == 0
