"""From features to written results: sets of probabilities, normalising, exact correlations, encodings, buckets."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwell.functions import special
from driftwell.operators import categorize, features, frame, hierarchy, outliers, windows


def test_far_tails_keep_their_logs():
    assert special.log_gamma_upper(1, 5000) == pytest.approx(-5000)
    assert special.log_gamma_upper(2, 3000) == pytest.approx(-3000 + math.log(3001))
    assert special.gamma_upper(0.5, 2) == pytest.approx(math.erfc(math.sqrt(2)))
    p = np.array([1.0, 0.3173105078629141, 1e-9, 1e-100, 1e-300])
    assert [math.erfc(z / math.sqrt(2)) for z in special.two_sided_deviation(p)] == pytest.approx(p.tolist(), rel=1e-10)


def test_binomial_tails():
    p = np.sort(np.random.default_rng(1).uniform(0, 0.3, 9))
    for least, most in ((1, 1), (1, 5), (2, 4)):
        want = min(math.log(sum(math.comb(9, k) * p[i - 1] ** k * (1 - p[i - 1]) ** (9 - k) for k in range(i, 10))) for i in range(least, most + 1))
        assert hierarchy.log_extreme(p, 9, least, most) == pytest.approx(want)


def test_scores_go_on_below_the_least_double():
    down = [hierarchy.overall_score(np.full(n, 1e-200), "attributes")[0] for n in (1, 2, 20, 200, 2000)]
    assert down == sorted(down) and len(set(down)) == 5 and down[-1] <= 100
    s, p = hierarchy.overall_score(np.array([1e-6, 1e-7]), "attributes")
    assert hierarchy.score_of(p) == pytest.approx(s / 0.8)


def test_combined_merges_and_skips_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(p)) for k, n in ((1, 400), (2, 3), (None, 2)) for p in rng.uniform(1e-6, 1, n)]
    df = spark.createDataFrame(rows + [(1, None), (3, None)], "k int, p double")
    got = {r["k"]: r for r in hierarchy.combined(df, ["k"], "p", "attributes").collect()}
    assert set(got) == {1, 2, None}
    for k, r in got.items():
        score, p = hierarchy.overall_score(np.array([q for j, q in rows if j == k]), "attributes")
        assert (r["score"], r["probability"]) == (pytest.approx(score), pytest.approx(p))
    assert hierarchy.combined(df.where("false"), ["k"], "p").count() == 0


def test_population_weights(spark):
    df = spark.createDataFrame([(1, "a", 0.01, 0.5, 1.0), (1, "b", 0.2, 0.5, 0.5), (2, "a", 0.3, None, 1.0)], "u int, attr string, p double, c double, w double")
    got = {r["u"]: r["probability"] for r in hierarchy.population_combined(df, ["u"], "attr", "p", "c", "w").collect()}
    z = special.two_sided_deviation
    each = [math.exp(-(z([p])[0] ** 2 + z([0.5])[0] ** 2) / 2) for p in (0.01, 0.2)]
    squares = z([each[0]])[0] ** 2 + 0.5 * z([each[1]])[0] ** 2
    assert got == {1: pytest.approx(special.gamma_upper(0.75, squares / 2)), 2: pytest.approx(0.3)}


def test_running_totals_by_value(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v), int(n)) for k in (0, 1) for v, n in zip(np.unique(rng.lognormal(0, 3, 900)), rng.integers(1, 9, 900))]
    got = windows.running_totals_by_value(spark.createDataFrame(rows, "k int, v double, n int"), ["k"], "v", ["n"], 16).toPandas()
    want = got.sort_values("v").groupby("k")["n"].cumsum()
    assert len(got) == len(rows) and (got["n_upto"] == want.reindex(got.index)).all()


def test_normalised_ties_nulls_and_one_row(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 5.0), (4, 9.0), (5, None)], "k int, s double")
    for f in (hierarchy.normalise, hierarchy.ceilings):
        got = {r["k"]: r["normalised"] for r in f(df, [], "s").collect()}
        assert got[1] == 0 and got[2] == got[3] < got[4] <= 100 and got[5] is None
        assert f(df.where("k = 4"), [], "s").count() == 1 and f(df.where("false"), [], "s").count() == 0


def test_most_correlated_is_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 12))
    wide = np.concatenate([base[i % 5] * (1 if i % 2 else -1) + rng.normal(size=12) * 0.4 for i in range(40)]).reshape(40, 12)
    wide[rng.random(wide.shape) < 0.2] = np.nan
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(wide) if not np.isnan(v)] + [(99, 0, 1.0), (98, 1, None)]
    got = outliers.most_correlated(spark.createDataFrame(rows, "s int, b int, v double"), "s", "b", "v", 15, block=9).collect()
    frame_ = pd.DataFrame(wide.T).corr(min_periods=3)
    want = sorted(((a, b, frame_.loc[a, b]) for a in range(40) for b in range(a + 1, 40) if frame_.notna().loc[a, b]), key=lambda t: (-abs(t[2]), t[0], t[1]))[:15]
    assert [(r["a"], r["b"]) for r in got] == [w[:2] for w in want]
    assert [r["correlation"] for r in got] == pytest.approx([w[2] for w in want])


def test_processors_and_tokens_take_nulls(spark):
    df = spark.createDataFrame([("abc", "x"), ("a", None), (None, "y")], "t string, c string")
    out = frame.preprocessed(df, [
        {"kind": "n_gram", "field": "t", "start": 1, "length": 2, "n_grams": [2]},
        {"kind": "one_hot", "field": "c", "values": {"x": "is_x"}},
        {"kind": "frequency", "field": "c", "table": {"x": 0.5}, "default": 0.1, "column": "f"},
    ]).collect()
    assert [(r["t.20"], r["is_x"], r["f"]) for r in out] == [("bc", 1, 0.5), ("", 0, 0.1), ("", 0, 0.1)]
    with pytest.raises(ValueError):
        frame.preprocessed(df, [{"kind": "other"}])
    lines = spark.createDataFrame([('a,"b, ""c""",,d',), ("",), (None,)], "l string")
    assert [r[0] for r in lines.select(categorize.tokens_of_csv(F.col("l"))).collect()] == [["a", 'b, "c"', "d"], [], []]


def test_first_buckets(spark):
    df = spark.range(100, 1000, 50).select(F.timestamp_seconds("id").alias("ts"), "id")
    first = lambda **k: features.whole_buckets(df, "ts", 300, **k).agg(F.min("id")).first()[0]
    assert (first(), first(restored=True), first(restored=True, latency=100)) == (100, 300, 200)
    assert features.whole_buckets(df.where("false"), "ts", 300).count() == 0


def test_series_do_not_travel_to_meet(spark):
    rows = spark.range(600).selectExpr("CAST(id % 60 AS INT) AS s", "CAST(id / 60 AS INT) AS b", "CAST(hash(id) % 100 AS DOUBLE) AS v")
    plan = outliers.most_correlated(rows, "s", "b", "v", 5, block=9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
