import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwell.functions import expressions as X
from driftwell.functions import special, text
from driftwell.operators import boost, categorize, cluster, features, frame, hierarchy, inference, models, outliers, rules, timeseries
from driftwell.plans.config import Detector
from driftwell.sources import readers, writers

EVENTS = [(0, "a", 1.0), (10, "a", 3.0), (70, "b", 5.0), (130, None, 7.0), (190, "a", None), (200, "", 2.0)]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, "t long, who string, v double").withColumn("ts", F.timestamp_seconds("t"))


def values(df):
    return {(r["bucket"], r["person"]): r["value"] for r in df.collect()}


def test_counts_are_zero_filled_from_first_sight(events):
    got = values(features.feature_values(events, Detector("count", by="who"), "ts", 60))
    assert got == {(0, "a"): 2, (60, "a"): 0, (120, "a"): 0, (180, "a"): 1, (60, "b"): 1, (120, "b"): 0, (180, "b"): 0, (180, ""): 1}


def test_null_person_only_with_use_null(events):
    assert (120, "") not in values(features.feature_values(events, Detector("nzc", by="who"), "ts", 60))
    assert values(features.feature_values(events, Detector("nzc", by="who", use_null=True), "ts", 60))[120, ""] == 1


def test_varp_needs_two_values_and_nulls_take_no_part(events):
    assert values(features.feature_values(events, Detector("varp", "v", by="who"), "ts", 60)) == {(0, "a"): 1.0}
    assert (180, "a") not in values(features.feature_values(events, Detector("mean", "v", by="who"), "ts", 60))


def test_summary_counts(spark):
    df = spark.createDataFrame([(0, "a", 2.0, "3"), (5, "a", 8.0, "1.4"), (61, "a", 1.0, "null"), (70, "b", 1.0, "0"), (80, "b", 1.0, "x"), (130, "a", 1.0, "2")], "t long, who string, v double, n string").withColumn("ts", F.timestamp_seconds("t"))
    assert values(features.feature_values(df, Detector("mean", "v", by="who"), "ts", 60, "n"))[0, "a"] == 3.5
    assert values(features.feature_values(df, Detector("count", by="who"), "ts", 60, "n")) == {(0, "a"): 4, (120, "a"): 2}


def test_info_content_is_the_compressed_length(spark, events):
    import zlib

    got = values(features.feature_values(events, Detector("info_content", "v", by="who"), "ts", 60))
    assert got[0, "a"] == len(zlib.compress(b"1.03.0"))


def test_empty_table(spark, events):
    none = events.limit(0)
    for f, field in (("count", None), ("mean", "v"), ("rare", None), ("info_content", "v")):
        assert features.feature_values(none, Detector(f, field, by="who"), "ts", 60).count() == 0


def test_scores_and_inverse(spark):
    ps = [1.0, 0.05, 0.049, 1e-4, 1e-5, 1e-50, 1e-200, 0.0]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", X.anomaly_score("p").alias("s")).select("p", "s", X.probability_of_score("s").alias("q")).collect()
    assert [r["s"] for r in rows] == pytest.approx([hierarchy.score_of(p) for p in ps]) and rows[-1]["s"] == pytest.approx(100)
    for r in rows[2:-1]:
        assert r["q"] == pytest.approx(r["p"], rel=1e-6)


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.gamma_upper(1.0, 2.0) == pytest.approx(math.exp(-2))
    assert special.gamma_upper(0.5, 0.3) == pytest.approx(math.erfc(math.sqrt(0.3)))
    assert special.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483)
    assert special.f_right_tail(4.0, 1, 10) == pytest.approx(special.t_two_sided(2.0, 10))
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.normal(size=300)
    assert special.ks_two_sample(x, y)[1] > 0.01 > special.ks_two_sample(x, y + 1)[1]


def test_joint_probability():
    assert special.joint_less_likely(np.array([0.3])) == 0.3
    assert special.joint_less_likely(np.array([])) == 1.0
    assert special.joint_less_likely(np.array([1e-4, 1e-4])) < 1e-6 < special.joint_less_likely(np.array([1e-4, 0.9]))
    assert special.joint_less_likely(np.full(5, 1.0)) == 1.0


def test_overall_scores():
    assert hierarchy.overall_score(np.array([0.5, 0.6]), "detectors")[0] == 0
    assert hierarchy.overall_score(np.array([1e-30, 0.6]), "detectors")[0] > hierarchy.overall_score(np.array([1e-6, 0.6]), "detectors")[0] > 0


def test_models_find_the_spike_and_pick_a_distribution():
    rng = np.random.default_rng(1)
    x = rng.poisson(20, 200).astype(float)
    x[150] = 90
    typical, p, name = models.series_scores(x, True, "two_sided", 0.0005)
    assert int(np.argmin(p)) == 150 and p[150] < 1e-6 and abs(typical[-1] - 20) < 2
    assert models.series_scores(rng.poisson(3, 400).astype(float), True, "two_sided", 0.0)[2] == "poisson"
    assert models.series_scores(rng.normal(50, 2, 400), False, "two_sided", 0.0)[2] in ("normal", "gamma", "log_normal")
    assert len(models.series_scores(np.array([]), True, "low", 0.1)[1]) == 0


def test_two_modes_are_both_usual():
    x = np.tile([1.0, 1.1, 100.0, 101.0], 50)
    assert models.series_scores(x, False, "two_sided", 0.0)[1][-4:].min() > 1e-3


def series(n, f, span=3600):
    t = np.arange(n) * span
    return t, f(t)


def test_seasonality_and_forecast():
    rng = np.random.default_rng(2)
    t, x = series(24 * 21, lambda t: 50 + 10 * np.sin(2 * np.pi * t / 86400) + rng.normal(0, 1, len(t)))
    assert [p for p, _ in timeseries.find_periods(t, x, 3600)][0] == 86400
    assert timeseries.find_periods(t, rng.normal(size=len(t)), 3600) == []
    pdf = pd.DataFrame({"bucket": t, "value": x})
    d = timeseries.decompose_series(*timeseries.regular(pdf, "bucket", 3600), 3600)
    assert d["rest"].std() < 1.3


def test_forecast_rows(spark):
    t, x = series(24 * 14, lambda t: 50 + 10 * np.sin(2 * np.pi * t / 86400))
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "bucket": t, "v": x}))
    out = timeseries.forecast(df, ["k"], "bucket", "v", 3600, 86400).orderBy("bucket").toPandas()
    want = 50 + 10 * np.sin(2 * np.pi * out["bucket"] / 86400)
    assert len(out) == 24 and np.abs(out["prediction"] - want).max() < 1.5 and (out["lower"] <= out["prediction"]).all()


def test_change_point_and_segments():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 200)
    assert timeseries.detect_change(x)[0] == "none"
    x[120:] += 8
    kind, place, size, p = timeseries.detect_change(x)
    assert kind == "level_shift" and abs(place - 120) <= 2 and abs(size - 8) < 1 and p < 1e-6
    cuts = timeseries.segment(np.concatenate([np.linspace(0, 10, 60), np.linspace(10, -20, 60)]) + rng.normal(0, 0.1, 120))
    assert len(cuts) >= 2 and min(abs(c - 60) for c in cuts) <= 3


def test_lowess_follows_a_line():
    t = np.arange(50.0)
    assert np.abs(timeseries.lowess(t, 2 * t + 1) - (2 * t + 1)).max() < 1e-6


def test_tokens(spark):
    rows = spark.createDataFrame([("Mon 10:23 node-3.prod connection to /var/log failed deadbeef1 0xFF 123abc\nsecond line",), (None,), ("",)], "t string").select(categorize.tokens_of(F.col("t")).alias("k")).collect()
    assert rows[0]["k"] == ["node-3.prod", "connection", "to", "/var/log", "failed"] and rows[1]["k"] == [] == rows[2]["k"]


def test_categorizer_groups_alike_messages():
    c = categorize.Categorizer()
    a = "Connection to host alpha failed after retry".split()
    b = "Connection to host beta failed after retry".split()
    assert c.category(a, 40) == 1 == c.category(b, 40) and c.category("Disk is full on volume data".split(), 20) == 2
    terms, regex = c.categories[0].reverse_search()
    import re

    assert "alpha" not in terms and re.match(regex, "Connection to host gamma failed after retry")
    assert c.category([], 0) == 3 == c.category([], 0)


def test_weights_rise_with_dictionary_runs():
    words = frozenset(["disk", "is", "full", "now"])
    assert categorize.weights_of(["disk", "is", "full", "x"], words) == [3, 3, 13, 1]


def test_lof_flags_the_outlier(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(0, 1, (60, 3)), [[9, 9, 9]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "k long, v array<double>")
    knn = outliers.neighbours(df, "k", "v", 5).cache()
    for scores in (outliers.lof(knn), outliers.distance_knn(knn), outliers.ldof(df, "k", "v", knn), outliers.ensemble(df, "k", "v").withColumnRenamed("outlier_score", "score")):
        assert scores.orderBy(F.desc("score")).first()["key"] == 60
    assert outliers.neighbours(df.limit(3), "k", "v", 5).count() == 6  # fewer points than k


def test_most_correlated(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=60)
    rows = [(f"s{i:02d}", t, float(v)) for i in range(20) for t, v in enumerate(base + rng.normal(0, 0.1, 60) if i in (3, 11) else -base + rng.normal(0, 0.1, 60) if i == 7 else rng.normal(size=60))]
    out = outliers.most_correlated(spark.createDataFrame(rows, "s string, b long, v double"), "s", "b", "v", 3).collect()
    assert {(r["a"], r["b"]) for r in out} == {("s03", "s11"), ("s03", "s07"), ("s07", "s11")}


def test_shapley_sums_to_the_prediction(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, *map(float, r), float(3 * r[0] - r[1] * (r[2] > 0))) for i, r in enumerate(x)], "k long, a double, b double, c double, y double")
    model = boost.train_regression(df, ["a", "b", "c"], "y", trees=5, depth=3)
    p = {r["k"]: r["prediction"] for r in boost.predict_regression(model, df, ["a", "b", "c"]).collect()}
    imp = boost.feature_importance(model, df, "k", ["a", "b", "c"]).collect()
    assert all(r["baseline"] + sum(r["importances"]) == pytest.approx(p[r["key"]], abs=1e-6) for r in imp)
    total = {r["feature"]: r["importance"] for r in boost.total_importance(boost.feature_importance(model, df, "k", ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert total["a"] > total["b"] and '"trained_models"' in boost.model_definition(model, ["a", "b", "c"])
    one, trees = x[:1], boost.export_trees(model)
    brute = brute_shapley(trees, one)
    assert boost.shapley(trees, one)[0] == pytest.approx(brute, abs=1e-9)


def brute_shapley(trees, x):
    from itertools import combinations

    d = x.shape[1]
    value = lambda s: sum(boost.conditional_value(t, x, set(s))[0] for t in trees)
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        out.append(sum(math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d) * (value([*s, i]) - value(s)) for n in range(d) for s in combinations(rest, n)))
    return out


def test_three_classes_and_recall_threshold(spark):
    rows = [(float(i % 3) + 0.01 * (i % 7), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "x double, c string")
    fitted, classes = boost.train_classification(df, ["x"], "c", trees=2, depth=2)
    out = boost.predict_classification(fitted, classes, df, ["x"]).select("c", "prediction").collect()
    assert all(r["c"] == r["prediction"] for r in out)
    scored = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.1)], "y int, p double")
    t, least = boost.class_weights(scored, "y", "p")
    assert 0.7 < t <= 0.8 and least == 1.0


def test_losses(spark):
    df = spark.createDataFrame([(float(i), float(np.exp(i / 10))) for i in range(60)], "x double, y double")
    for loss in ("mse", "msle", "huber"):
        m = boost.train_regression(df, ["x"], "y", loss, 5.0, trees=10, depth=3)
        err = boost.predict_regression(m, df, ["x"], loss).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert err < 25


def test_clusters(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "k long, v array<double>")
    assert cluster.x_means(df, "k", "v", 5)[1] == 3
    merges = cluster.agglomerate(np.array([[0.0], [0.1], [5.0]]), "single")
    assert merges[0][:2] == (0, 1) and merges[1][2] == pytest.approx(4.9)
    assert [cluster.agglomerate(np.array([[0.0], [1.0], [5.0]]), k)[1][2] for k in ("complete", "average", "weighted")] == pytest.approx([5, 4.5, 4.5])
    assert cluster.natural_breaks(np.array([1.0, 1, 2, 10, 11, 30]), 3) == [2.0, 11.0, 30.0]


def test_mic():
    rng = np.random.default_rng(8)
    x = rng.uniform(size=500)
    assert frame.mic(x, x**2) > 0.9 > 0.4 > frame.mic(x, rng.uniform(size=500)) and frame.mic(x, np.ones(500)) == 0


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, y double")
    n = frame.folds(df, "y", 4, ["k"], True).groupBy("fold").count().collect()
    assert {r["count"] for r in n} <= {20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30} and len(n) == 4


def test_length_encoded_round_trip(spark, tmp_path):
    data = readers.encode_length_encoded(["a", "b"], [["1", "x,\n"], ["", "é"]])
    assert readers.decode_length_encoded(data) == [{"a": "1", "b": "x,\n"}, {"a": "", "b": "é"}]
    (tmp_path / "f.bin").write_bytes(data)
    out = readers.widen(readers.read_length_encoded(spark, str(tmp_path / "f.bin")), ["a", "b", "none"]).collect()
    assert [tuple(r) for r in out] == [("1", "x,\n", None), ("", "é", None)]
    with pytest.raises(ValueError):
        readers.decode_length_encoded(data[:-1])


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,msg\n1,"say ""hi"",\nthere"\n2,ok\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'say "hi",\nthere'), ("2", "ok")]
    (tmp_path / "a.ndjson").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [(r["a"], r["b"]) for r in readers.widen(readers.read_ndjson(spark, str(tmp_path / "a.ndjson")), ["a", "b"]).collect()] == [("1", "x"), ("2", None)]
    good, bad = readers.parse_time(spark.createDataFrame([("1700000000",), ("x",)], "t string"), "t")
    assert good.count() == 1 and bad.first()["rejected"] == 1
    good, bad = readers.parse_time(spark.createDataFrame([("2024-01-02 03:04:05",), ("nope",)], "t string"), "t", "yyyy-MM-dd HH:mm:ss")
    assert good.select(X.epoch("ts")).first()[0] == 1704164645 and bad.first()["rejected"] == 1
    split = readers.split_csv_lines(spark.createDataFrame([('1,"a,b"',)], "line string"), "line", ["n", "s"]).first()
    assert (split["n"], split["s"]) == ("1", "a,b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_ndjson(df, str(tmp_path / "j"))
    writers.save_snapshot(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 == writers.restore_snapshot(spark, str(tmp_path / "p")).count()
    assert writers.as_documents(df, "record").first()["document"].startswith('{"record":{')


def test_inference_errors_stay_with_their_rows(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", [3]), ("c", [1, 2]), ("d", None)], "request_id string, tokens array<long>")

    def make():
        def model(batch):
            if any(3 in t for t in batch):
                raise ValueError("bad token")
            return [[float(t.sum())] for t in batch]

        return model

    out = {r["request_id"]: r for r in inference.infer(df, "tokens", make).collect()}
    assert out["a"]["inference"] == [3.0] == out["c"]["inference"] and out["c"]["cache_hit"] and not out["a"]["cache_hit"]
    assert out["b"]["error"] == "bad token" and out["d"]["error"] == "no tokens"


def test_patterns_with_nulls(spark):
    df = spark.createDataFrame([("foo",), ("food",), ("a foo b",), (None,)], "s string")
    got = lambda p: [r[0] for r in df.select(rules.matches_patterns(F.col("s"), p)).collect()]
    assert got(["foo"]) == [True, False, False, False] and got(["foo*"]) == [True, True, False, False] and got(["*foo*"]) == [True, True, True, False] and got([]) == [False] * 4


def test_text_functions():
    assert text.longest_common_substring("xabcy", "zabcw") == "abc" and text.longest_common_subsequence("abcbdab", "bdcaba") in ("bcba", "bdab", "bcab")
    assert text.compression_similarity("aaaa" * 50, "aaaa" * 50) > text.compression_similarity("the quick brown fox", "1928374655 lorem ips")


def test_aggregated_inference_modes(spark):
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))
    r = spark.range(1).select(boost.aggregate_inference(v, "weighted_mode").alias("m"), boost.aggregate_inference(v, "exponent").alias("e")).first()
    assert r["m"] == 2.0 and r["e"] == pytest.approx(math.exp(5))
