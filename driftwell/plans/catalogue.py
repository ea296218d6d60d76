"""The queries over the driver's tables and the SQL that states their results."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import expressions as X
from driftwell.functions import text as TX
from driftwell.operators import boost, categorize, cluster, features, frame, hierarchy, inference, models, online, outliers, rules, seasons, series, timeseries, trees, windows
from driftwell.plans import job
from driftwell.plans.config import FUNCTIONS, Condition, Detector, JobConfig, Rule
from driftwell.sources import writers

HOUR = 3600
#: Added before rounding, here and in the SQL: the tables' values have two decimals, so means of them often lie just between
#: two roundings, where the order of summation would decide.
NUDGE = 1.23e-8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = re.sub(r", (\d+)\) \+ 0\.0", rf" + {NUDGE}, \1) + 0.0", sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Columns rounded, and never minus zero."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c) + NUDGE, places) + F.lit(0.0))
    return df


# --- detector functions ------------------------------------------------------------------------

BUCKET = f"CAST(floor(epoch(ts) / {HOUR}) * {HOUR} AS BIGINT)"
DAY_BUCKET = "CAST(floor(epoch(l_shipdate) / 86400) * 86400 AS BIGINT)"
VALUE_SQL = {
    "count": "count(*)",
    "distinct": "count(DISTINCT user_id)",
    "time_of_day": "CAST(trunc(avg(CAST(floor(epoch(ts)) AS BIGINT) % 86400)) AS BIGINT)",
    "time_of_week": "CAST(trunc(avg(CAST(floor(epoch(ts)) AS BIGINT) % 604800)) AS BIGINT)",
    "mean": "round(avg(value), 6) + 0.0",
    "median": "round(median(value), 6) + 0.0",
    "varp": "CASE WHEN count(value) >= 2 THEN round(var_pop(value), 4) + 0.0 END",
    "sum": "round(sum(value), 4) + 0.0",
    "min": "min(value)",
    "max": "max(value)",
}


def event_detector(f: str, over: bool) -> Detector:
    spec = FUNCTIONS[f]
    field = ("user_id" if spec.value == "distinct" else "value") if spec.field else None
    return Detector(f, field, by="event_type", over="user_id" if over else None) if not (over and spec.value == "distinct") else Detector(f, "value", by="event_type", over="user_id")


def shaped(df: DataFrame, spec, population: bool) -> DataFrame:
    keys = ["bucket", "person", *(["attribute"] if population else [])]
    places = 4 if spec.value in ("sum", "varp") else 6
    exact = spec.value in ("count", "distinct", "time_of_day", "time_of_week", "min", "max", "rare", "rare_count", "freq_rare", "freq_rare_count", "info_content")
    out = df if exact else rounded(df, "value", places=places)
    return out.select(*keys, *[c for c in ("value", "n", "total") if c in df.columns], F.lit(spec.tail).alias("tail"))


def detector_query(f: str, over: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = event_detector(f, over)
        return shaped(features.feature_values(read(spark, sf_dir, "events"), d, "ts", HOUR), d.spec, over)

    return run


def detector_sql(f: str, over: bool) -> str | None:
    spec = FUNCTIONS[f]
    tail = f"'{spec.tail}' AS tail"
    rows = f"SELECT {BUCKET} AS bucket, event_type, CAST(user_id AS VARCHAR) AS u, user_id, value, ts FROM events"
    keys = "bucket, u AS person, event_type AS attribute" if over else "bucket, event_type AS person"
    by = "bucket, u, event_type" if over else "bucket, event_type"
    if spec.value == "info_content":
        return None
    if spec.value.startswith(("rare", "freq_rare")):
        per = f"WITH e AS ({rows}), p AS (SELECT {by}, count(*) AS n FROM e GROUP BY {by})"
        if not over:
            n = ", n" if spec.name == "rare_non_zero_count" else ""
            return f"{per}, k AS (SELECT event_type, count(DISTINCT bucket) AS value FROM p GROUP BY 1) SELECT bucket, event_type AS person, value{n}, {tail} FROM p JOIN k USING (event_type)"
        n = ", n" if spec.value in ("rare_count", "freq_rare_count") else ""
        total = ", total" if spec.value.startswith("freq") else ""
        return (
            f"{per}, k AS (SELECT event_type, count(DISTINCT u) AS value FROM p GROUP BY 1), "
            f"t AS (SELECT u, event_type, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY 1, 2) "
            f"SELECT {keys}, value{n}{total}, {tail} FROM p JOIN k USING (event_type) JOIN t USING (u, event_type)"
        )
    value = VALUE_SQL[spec.value].replace("DISTINCT user_id", "DISTINCT value" if over else "DISTINCT user_id")
    if spec.zero_fill and not over:
        zero = "0" if spec.value == "count" else "0.0"
        return (
            f"WITH e AS ({rows}), v AS (SELECT bucket, event_type, {value} AS value FROM e GROUP BY ALL), "
            f"k AS (SELECT event_type, min(bucket) AS f FROM v GROUP BY 1), m AS (SELECT max(bucket) AS t FROM v), "
            f"g AS (SELECT event_type, unnest(range(f, t + 1, {HOUR})) AS bucket FROM k, m) "
            f"SELECT g.bucket, g.event_type AS person, coalesce(v.value, {zero}) AS value, {tail} FROM g LEFT JOIN v ON g.bucket = v.bucket AND g.event_type = v.event_type"
        )
    having = " HAVING count(value) >= 2" if spec.value == "varp" else ""
    return f"WITH e AS ({rows}) SELECT {keys}, {value} AS value, {tail} FROM e GROUP BY {by}{having}"


for _name in sorted({f.name for f in FUNCTIONS.values()}):
    _spec = FUNCTIONS[_name]
    if _spec.value in ("metric", "lat_long") or "velocity" in _name:
        continue
    if _spec.individual:
        query(detector_sql(_name, False), f"detector_{_name}")(detector_query(_name, False))
    if _spec.population:
        query(detector_sql(_name, True), f"population_{_name}")(detector_query(_name, True))


@query(f"SELECT {BUCKET} AS bucket, event_type AS person, round(avg(value), 6) + 0.0 AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def detector_metric(spark, sf_dir):
    out = features.feature_values(read(spark, sf_dir, "events"), Detector("metric", "value", by="event_type"), "ts", HOUR)
    return rounded(out.select("bucket", "person", F.col("value.mean").alias("mean"), F.col("value.min").alias("low"), F.col("value.max").alias("high")), "mean")


@query(f"SELECT {DAY_BUCKET} AS bucket, CAST(l_suppkey AS VARCHAR) AS person, round(avg(l_discount * 100), 6) + 0.0 AS lat, round(avg(l_tax * 100), 6) + 0.0 AS lon FROM lineitem GROUP BY 1, 2")
def detector_lat_long(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("place", F.concat_ws(",", F.col("l_discount") * 100, F.col("l_tax") * 100))
    out = features.feature_values(rows, Detector("lat_long", "place", by="l_suppkey"), "l_shipdate", X.DAY)
    return rounded(out.select("bucket", "person", "value.lat", "value.lon"), "lat", "lon")


def velocity(f: str, agg: str):
    zero = f == "sum_velocity"
    base = f"SELECT {DAY_BUCKET} AS bucket, l_returnflag AS person, round({agg}(l_quantity), 4) + 0.0 AS value FROM lineitem GROUP BY 1, 2"
    sql = base
    if zero:
        sql = (
            f"WITH v AS ({base}), k AS (SELECT person, min(bucket) AS f FROM v GROUP BY 1), m AS (SELECT max(bucket) AS t FROM v), "
            "g AS (SELECT person, unnest(range(f, t + 1, 86400)) AS bucket FROM k, m) "
            "SELECT g.bucket, g.person, coalesce(v.value, 0.0) AS value FROM g LEFT JOIN v ON g.bucket = v.bucket AND g.person = v.person"
        )

    @query(sql, f"detector_{f}")
    def run(spark, sf_dir):
        out = features.feature_values(read(spark, sf_dir, "lineitem"), Detector(f, "l_quantity", by="l_returnflag"), "l_shipdate", X.DAY)
        return rounded(out.select("bucket", "person", "value"), "value", places=4)


for _f, _agg in (("max_velocity", "max"), ("min_velocity", "min"), ("mean_velocity", "avg"), ("sum_velocity", "sum")):
    velocity(_f, _agg)


@query(f"SELECT {BUCKET} AS bucket, event_type AS person, count(*) AS events, round(avg(value), 6) + 0.0 AS mean, max(value) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def shared_aggregation(spark, sf_dir):
    ds = [Detector("non_zero_count", by="event_type"), Detector("mean", "value", by="event_type"), Detector("max", "value", by="event_type"), Detector("distinct_count", "user_id", by="event_type")]
    out = features.shared_features(read(spark, sf_dir, "events"), ds, "ts", HOUR)
    return rounded(out.select("bucket", "person", F.col("d0").alias("events"), F.col("d1").alias("mean"), F.col("d2").alias("high"), F.col("d3").alias("users")), "mean")


@query(f"SELECT {DAY_BUCKET} AS bucket, l_returnflag AS person, round(sum(l_extendedprice * floor(l_quantity + 0.5)) / sum(floor(l_quantity + 0.5)), 4) + 0.0 AS value FROM lineitem WHERE floor(l_quantity + 0.5) > 0 GROUP BY 1, 2")
def summary_count_mean(spark, sf_dir):
    out = features.feature_values(read(spark, sf_dir, "lineitem"), Detector("mean", "l_extendedprice", by="l_returnflag"), "l_shipdate", X.DAY, "l_quantity")
    return rounded(out.select("bucket", "person", "value"), "value", places=4)


@query(f"SELECT {BUCKET} AS bucket, count(*) AS event_count FROM events GROUP BY 1")
def counting_model(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket")).agg(F.count(F.lit(1)).alias("event_count"))


@query(f"SELECT {BUCKET} AS bucket, event_type AS partition, CAST(user_id AS VARCHAR) AS person, count(*) AS value FROM events GROUP BY 1, 2, 3")
def partitioned_count(spark, sf_dir):
    return features.feature_values(read(spark, sf_dir, "events"), Detector("non_zero_count", by="user_id", partition="event_type"), "ts", HOUR).select("bucket", "partition", "person", "value")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_type, CAST(floor(i / 10) AS BIGINT) AS sample, round(avg(value), 6) + 0.0 AS value, count(value) AS count FROM r GROUP BY 1, 2")
def fixed_count_samples(spark, sf_dir):
    return rounded(features.fixed_count_samples(read(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value", 10), "value")


@query(f"SELECT {BUCKET} AS bucket, event_type AS person, 'user_id' AS influencer, CAST(user_id AS VARCHAR) AS influencer_value, round(sum(value), 4) + 0.0 AS value FROM events GROUP BY 1, 2, 4")
def influencer_values(spark, sf_dir):
    out = features.influences(read(spark, sf_dir, "events"), Detector("sum", "value", by="event_type"), ["user_id"], "ts", HOUR)
    return rounded(out.drop("partition"), "value", places=4)


@query(f"WITH d AS (SELECT DISTINCT {BUCKET} AS bucket, event_type AS person FROM events) SELECT bucket, person, count(*) OVER (PARTITION BY person ORDER BY bucket) AS seen FROM d")
def running_rarity(spark, sf_dir):
    rows = features.prepared(read(spark, sf_dir, "events"), Detector("rare", by="event_type"), "ts", HOUR)
    return features.running_rarity(rows).select("bucket", "person", "seen")


# --- filters and rules -------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE floor(epoch(ts)) >= 1705000000")
def late_filter(spark, sf_dir):
    return rules.late_rows(read(spark, sf_dir, "events"), X.epoch("ts"), 1_705_000_000).select("event_id", "event_type")


HOURLY = f"SELECT {BUCKET} AS bucket, event_type, avg(value) AS actual FROM events GROUP BY 1, 2"


def hourly(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket"), "event_type").agg(F.avg("value").alias("actual"))


@query(
    f"WITH h AS ({HOURLY}) SELECT bucket, event_type, round(actual, 6) + 0.0 AS actual, (actual > 300 AND abs(actual - 250.0) > 75 AND (event_type = 'click' OR event_type LIKE 'pur%')) AS skip_result, (actual <= 100 AND NOT (event_type = 'error')) AS skip_model_update FROM h"
)
def rule_actions(spark, sf_dir):
    rs = [
        Rule(("skip_result",), (Condition("actual", "gt", 300.0), Condition("diff_from_typical", "gt", 75.0)), {"event_type": ("include", ("click", "pur*"))}),
        Rule(("skip_model_update",), (Condition("actual", "lte", 100.0),), {"event_type": ("exclude", ("error",))}),
    ]
    df = hourly(spark, sf_dir).withColumn("typical", F.lit(250.0))
    return rounded(rules.apply_rules(df, rs, "actual", "typical", "bucket").drop("typical"), "actual")


@query(f"WITH h AS ({HOURLY}) SELECT bucket, event_type FROM h WHERE bucket >= 1704500000 AND bucket < 1705500000")
def rule_time_condition(spark, sf_dir):
    holds = rules.condition(Condition("time", "gte", 1704500000), F.col("actual"), F.col("actual"), F.col("bucket")) & rules.condition(Condition("time", "lt", 1705500000), F.col("actual"), F.col("actual"), F.col("bucket"))
    return hourly(spark, sf_dir).where(holds).select("bucket", "event_type")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def rule_scope_include(spark, sf_dir):
    return rules.in_filter(read(spark, sf_dir, "customer"), "c_nationkey", read(spark, sf_dir, "nation").where("n_regionkey = 1"), "n_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def rule_scope_exclude(spark, sf_dir):
    return rules.in_filter(read(spark, sf_dir, "customer"), "c_nationkey", read(spark, sf_dir, "nation").where("n_regionkey = 1"), "n_nationkey", False).select("c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_brand = 'Brand#13' OR p_type LIKE 'STANDARD%' OR p_type LIKE '%COPPER' OR p_type LIKE '%BRUSH%'")
def pattern_set(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return df.where(rules.matches_patterns(F.col("p_brand"), ["Brand#13"]) | rules.matches_patterns(F.col("p_type"), ["STANDARD*", "*COPPER", "*BRUSH*"])).select("p_partkey", "p_type")


@query(f"WITH h AS ({HOURLY}) SELECT bucket, event_type, CASE WHEN bucket >= 1704500000 AND bucket < 1704900000 THEN 'release' WHEN bucket >= 1705500000 AND bucket < 1705700000 THEN 'outage' END AS in_event FROM h")
def scheduled_events(spark, sf_dir):
    return rules.scheduled(hourly(spark, sf_dir), "bucket", [("release", 1704500000, 1704900000), ("outage", 1705500000, 1705700000)]).drop("actual")


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS s FROM c) SELECT event_id FROM events WHERE event_type IN (SELECT event_type FROM c, t WHERE n <= 0.2 * s)")
def exclude_frequent_all(spark, sf_dir):
    return rules.exclude_frequent(read(spark, sf_dir, "events"), [], "event_type", 0.2).select("event_id")


@query("WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS f FROM c) SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM s WHERE s.l_returnflag = l.l_returnflag AND s.l_quantity = l.l_quantity AND f <= 0.02)")
def exclude_frequent_by(spark, sf_dir):
    return rules.exclude_frequent(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 0.02).select("l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '[*#$%&]+', '', 'g') AS stripped FROM conversations")
def categorization_filters(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", rules.strip_matches(F.col("text"), ["[0-9]+", "[*#$%&]+"]).alias("stripped"))


@query("SELECT d.doc_id, l.quality IS NOT NULL AS has_target FROM documents d LEFT JOIN labels l USING (doc_id)")
def training_mask(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("has_target"))


# --- windows -----------------------------------------------------------------------------------


@query(f"WITH h AS ({HOURLY}) SELECT bucket, event_type, round(avg(actual) OVER (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) + 0.0 AS multi_mean FROM h")
def multibucket_mean(spark, sf_dir):
    return rounded(windows.multibucket_mean(hourly(spark, sf_dir), ["event_type"], "bucket", "actual").drop("actual"), "multi_mean")


@query("WITH g AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS gap FROM events) SELECT * FROM g WHERE gap IS NOT NULL")
def inter_arrival(spark, sf_dir):
    return windows.inter_arrival(read(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"]).select("event_id", "user_id", "gap").where("gap is not null")


@query(f"WITH h AS ({HOURLY}), m AS (SELECT event_type, max(bucket) AS l FROM h GROUP BY 1) SELECT event_type, round(sum(actual * exp(-0.01 * (l - bucket) / {HOUR}.0)), 4) + 0.0 AS decayed FROM h JOIN m USING (event_type) GROUP BY 1")
def decayed_sum(spark, sf_dir):
    return rounded(windows.decayed_sum(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", 0.01, HOUR), "decayed", places=4)


@query(
    f"WITH h AS ({HOURLY}), r AS (SELECT event_type, min(bucket) AS f, max(bucket) AS l FROM h GROUP BY 1), w AS (SELECT *, CAST({HOUR} * pow(2, ceil(log2(greatest(1.0, ((l - f) / {HOUR}.0 + 1) / 48)))) AS BIGINT) AS wide FROM r) "
    "SELECT event_type, CAST(f + floor((bucket - f) / wide) * wide AS BIGINT) AS start, round(avg(actual), 6) + 0.0 AS mean, count(actual) AS count FROM h JOIN w USING (event_type) GROUP BY 1, 2"
)
def expanding_window(spark, sf_dir):
    return rounded(windows.expanding_window(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", HOUR, 48), "mean")


@query(f"WITH h AS (SELECT {BUCKET} AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT bucket, event_type, CAST(sum(n) OVER w AS BIGINT) AS running, count(*) OVER w AS buckets_so_far FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bucket)")
def running_totals(spark, sf_dir):
    h = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.running_totals(h, ["event_type"], "bucket", "n").drop("n")


@query(f"WITH h AS ({HOURLY}), l AS (SELECT event_type, actual, lag(actual, 24) OVER (PARTITION BY event_type ORDER BY bucket) AS b FROM h) SELECT event_type, round(corr(actual, b), 6) + 0.0 AS autocorrelation FROM l WHERE b IS NOT NULL GROUP BY 1")
def autocorrelation_lag(spark, sf_dir):
    return rounded(windows.autocorrelation(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", 24), "autocorrelation")


@query(f"WITH h AS ({HOURLY}) SELECT event_type, bucket % 86400 AS phase, round(avg(actual), 6) + 0.0 AS mean, count(actual) AS count FROM h GROUP BY 1, 2")
def seasonal_means(spark, sf_dir):
    return rounded(windows.seasonal_means(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", X.DAY), "mean")


def flagship(spark, sf_dir):
    """Hourly counts by event type, zero-filled, scored against the trailing day, most unusual first in each bucket."""
    values = features.feature_values(read(spark, sf_dir, "events"), Detector("high_count", by="event_type"), "ts", HOUR)
    scored = windows.trailing_score(values.withColumn("value", F.col("value").cast("double")), ["partition", "person"], "bucket", "value", "high")
    # equal chances tie whatever their last digits
    top = rules.top_records(scored.withColumn("order", F.round("probability", 12)), "bucket", "order", 3, ["person"])
    out = top.select("bucket", "person", F.col("value").alias("actual"), "typical", "probability", "score", X.severity("score").alias("severity"), F.col("rank").cast("long").alias("rank"))
    return rounded(out, "typical", "probability", "score")


@query()
def anomaly_job(spark, sf_dir):
    """A job of two detectors from events to the reported nodes of its hierarchy."""
    detectors = (Detector("high_count", by="event_type"), Detector("high_sum", "value", by="event_type"))
    out = job.run(read(spark, sf_dir, "events"), JobConfig(detectors, bucket_span=HOUR, time_field="ts"))
    return rounded(out.written_nodes(), "probability", "score", "normalised")


# --- scores ------------------------------------------------------------------------------------

P_SQL = "SELECT p_partkey, exp(-p_retailprice / 7.0) AS p FROM part"
SCORE_SQL = (
    "CASE WHEN p >= 0.05 THEN 0.0 WHEN p >= 1e-4 THEN (1 / p - 20.0) / (1e4 - 20.0) "
    "WHEN p >= 1e-50 THEN 1 + 49 * (ln(1e-4) - ln(p)) / (ln(1e-4) - ln(1e-50)) "
    "ELSE 50 + 50 * (ln(1e-50) - ln(greatest(p, 2.2250738585072014e-308))) / (ln(1e-50) - ln(2.2250738585072014e-308)) END"
)


def part_probabilities(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.exp(-F.col("p_retailprice") / 7.0).alias("p"))


@query(f"WITH s AS (SELECT p_partkey, {SCORE_SQL} AS s FROM ({P_SQL})) SELECT p_partkey, round(s, 6) + 0.0 AS score, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'major' WHEN s >= 25 THEN 'minor' ELSE 'warning' END AS severity FROM s")
def anomaly_scores(spark, sf_dir):
    out = part_probabilities(spark, sf_dir).withColumn("score", X.anomaly_score("p"))
    return rounded(out.select("p_partkey", "score", X.severity("score").alias("severity")), "score")


@query(f"WITH s AS (SELECT p_partkey, p, {SCORE_SQL} AS s FROM ({P_SQL})) SELECT p_partkey, round(CASE WHEN s <= 0 THEN ln(0.525) ELSE ln(greatest(p, 2.2250738585072014e-308)) END, 6) + 0.0 AS log_p FROM s")
def score_inverse(spark, sf_dir):
    out = part_probabilities(spark, sf_dir).withColumn("log_p", F.log(X.probability_of_score(X.anomaly_score("p"))))
    return rounded(out.select("p_partkey", "log_p"), "log_p")


@query(f"WITH h AS ({HOURLY}) SELECT event_type, count(*) AS n, round(1 - pow(1 - min(1 / (1 + actual)), count(*)), 9) + 0.0 AS extreme FROM h GROUP BY 1")
def extreme_samples(spark, sf_dir):
    h = hourly(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(1 / (1 + F.col("actual"))).alias("least"))
    return rounded(h.select("event_type", "n", X.extreme_probability("least", "n").alias("extreme")), "extreme", places=9)


IMPACT = "5 * least(s, m) / least(greatest(s, m), -0.001) / ln(1000) * (s - m)"


@query(f"WITH q AS (SELECT p_partkey, -p_size / 3.0 AS s, -p_retailprice / 500.0 AS m FROM part) SELECT p_partkey, floor(greatest(-5.0, least(5.0, {IMPACT})) * 100) / 100 AS impact FROM q")
def multibucket_impact(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.multibucket_impact(-F.col("p_size") / 3.0, -F.col("p_retailprice") / 500.0).alias("impact"))


@query(f"WITH c AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, round(greatest(0.0, least(1.0, n / 20.0)), 6) + 0.0 AS completeness FROM c")
def interim_completeness(spark, sf_dir):
    return rounded(counting_model(spark, sf_dir).select("bucket", X.completeness("event_count", F.lit(20.0)).alias("completeness")), "completeness")


@query(
    "WITH c AS (SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_shipdate, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY l_returnflag), 9) + 0.0 AS probability FROM c"
)
def category_probability(spark, sf_dir):
    return rounded(hierarchy.category_probability(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_shipdate"), "probability", places=9)


@query("WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c) SELECT event_type, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM t GROUP BY 1")
def entropy(spark, sf_dir):
    return rounded(hierarchy.shannon_entropy(read(spark, sf_dir, "events"), ["event_type"], "user_id"), "entropy")


LEAVES = f"SELECT {BUCKET} AS bucket, event_type AS part, CAST(user_id AS VARCHAR) AS person, 1 / (1 + sum(value)) AS p FROM events GROUP BY 1, 2, 3"


@query(
    f"WITH l AS ({LEAVES}) SELECT bucket, part AS partition, person, CASE grouping(part) + grouping(person) WHEN 0 THEN 'person' WHEN 1 THEN 'partition' ELSE 'root' END AS level, count(*) AS n, round(min(p), 12) + 0.0 AS least FROM l GROUP BY GROUPING SETS ((bucket, part, person), (bucket, part), (bucket))"
)
def hierarchy_levels(spark, sf_dir):
    leaves = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket"), F.col("event_type").alias("part"), F.col("user_id").cast("string").alias("person")).agg((1 / (1 + F.sum("value"))).alias("p"))
    return rounded(hierarchy.level_summaries(leaves, "bucket", "part", "person", "p").select("bucket", "partition", "person", "level", "n", "least"), "least", places=12)


@query(f"WITH e AS (SELECT {BUCKET} AS bucket, event_type, user_id, 1 / (1 + value) AS p FROM events) SELECT bucket, 'event_type' AS influencer, event_type AS influencer_value, count(*) AS n, round(min(p), 9) + 0.0 AS least FROM e GROUP BY 1, 3 UNION ALL SELECT bucket, 'user_id', CAST(user_id AS VARCHAR), count(*), round(min(p), 9) + 0.0 FROM e GROUP BY 1, 3")
def influencer_pivots(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(X.bucket_of("ts", HOUR).alias("bucket"), "event_type", "user_id", (1 / (1 + F.col("value"))).alias("p"))
    return rounded(hierarchy.influencer_pivots(e, ["event_type", "user_id"], "bucket", "p"), "least", places=9)


@query(f"WITH h AS ({HOURLY}), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY actual, event_type) AS rank FROM h) SELECT bucket, event_type, round(actual, 6) + 0.0 AS actual, rank FROM r WHERE rank <= 2")
def top_records(spark, sf_dir):
    return rounded(rules.top_records(hourly(spark, sf_dir), "bucket", "actual", 2, ["event_type"]).withColumn("rank", F.col("rank").cast("long")), "actual")


@query(
    "WITH s AS (SELECT c_custkey, greatest(c_acctbal, 0.0) AS s FROM customer), k AS (SELECT c_custkey, s, percent_rank() OVER (ORDER BY s) * 100 AS q, s / max(s) OVER () AS r FROM s) "
    "SELECT c_custkey, round(CASE WHEN s <= 0 THEN 0.0 ELSE least(CASE WHEN q <= 70 THEN q / 70.0 WHEN q <= 85 THEN 1 + (q - 70) / 15.0 * 0.2 WHEN q <= 90 THEN 1.2 + (q - 85) / 5.0 * 0.3 WHEN q <= 95 THEN 1.5 + (q - 90) / 5.0 * 1.5 WHEN q <= 97 THEN 3 + (q - 95) / 2.0 * 17 WHEN q <= 99 THEN 20 + (q - 97) / 2.0 * 30 WHEN q <= 99.9 THEN 50 + (q - 99) / 0.9 * 40 ELSE 90 + (q - 99.9) / 0.1 * 10 END, 100 * least(1.5 * r, 0.5 + 0.5 * r)) END, 4) + 0.0 AS normalised FROM k"
)
def normalised_scores(spark, sf_dir):
    s = read(spark, sf_dir, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("s"))
    return rounded(hierarchy.normalise(s, [], "s").select("c_custkey", "normalised"), "normalised", places=4)


@query("SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 9) + 0.0 AS equalised FROM part")
def detector_equaliser(spark, sf_dir):
    return rounded(hierarchy.equalised(read(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_partkey", "equalised"), "equalised", places=9)


@query(f"WITH e AS (SELECT {BUCKET} AS bucket, event_type, user_id, value FROM events), a AS (SELECT bucket, event_type, sum(value) AS s FROM e GROUP BY 1, 2), b AS (SELECT bucket, event_type, user_id, sum(value) AS s2 FROM e GROUP BY 1, 2, 3) SELECT bucket, event_type, user_id, round(greatest(0.0, least(1.0, 1 - (-(s - s2)) / least(-s, -1e-12))), 6) + 0.0 AS influence FROM a JOIN b USING (bucket, event_type)")
def influence_of_users(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(X.bucket_of("ts", HOUR).alias("bucket"), "event_type", "user_id", "value")
    a = e.groupBy("bucket", "event_type").agg(F.sum("value").alias("s"))
    b = e.groupBy("bucket", "event_type", "user_id").agg(F.sum("value").alias("s2"))
    out = b.join(a, ["bucket", "event_type"]).withColumn("influence", hierarchy.influence(-F.col("s"), -(F.col("s") - F.col("s2")), "without"))
    return rounded(out.select("bucket", "event_type", "user_id", "influence"), "influence")


# --- models and series -------------------------------------------------------------------------


@query()
def model_probabilities(spark, sf_dir):
    values = features.feature_values(read(spark, sf_dir, "events"), Detector("count", by="event_type"), "ts", HOUR)
    return models.model_scores(values, ["person"], "bucket", "value")


@query()
def population_probabilities(spark, sf_dir):
    values = features.feature_values(read(spark, sf_dir, "events"), Detector("mean", "value", by="event_type", over="user_id"), "ts", X.DAY)
    return models.population_scores(values, ["attribute"], "bucket", "value").select("attribute", "bucket", "person", F.col("value").alias("actual"), "typical", "probability", "model")


@query()
def series_model(spark, sf_dir):
    """Each hour against its type's model, whose forgetting follows its errors."""
    scored, _ = series.series_scores(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", HOUR)
    return rounded(scored, "actual", "typical", "lower", "upper", "multiplier")


@query()
def series_decomposition(spark, sf_dir):
    return timeseries.decompose(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", HOUR)


#: The hour of a level shift that is added to each type's series.
SHIFT = 1_705_320_000


def planted(spark, sf_dir, season: float):
    """Hourly means with a daily wave added, as the tables' own values hold none."""
    wave = F.sin(2 * math.pi * F.pmod("bucket", F.lit(X.DAY)) / X.DAY)
    return hourly(spark, sf_dir).withColumn("actual", F.col("actual") + season * wave)


@query("SELECT event_type, CAST(86400 AS BIGINT) AS period FROM events GROUP BY 1")
def series_seasonality(spark, sf_dir):
    """The strongest season of each type's series with a planted daily wave."""
    found = timeseries.seasonality(planted(spark, sf_dir, season=400.0), ["event_type"], "bucket", "actual", HOUR)
    return found.groupBy("event_type").agg(F.min_by("period", "p_value").alias("period"))


def changes(spark, sf_dir):
    """Changes of the series of all types together, by four hours, so that no bucket is empty on small tables either."""
    e = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", 4 * HOUR).alias("bucket")).agg(F.avg("value").alias("actual"))
    shifted = e.withColumn("actual", F.col("actual") + F.when(F.col("bucket") >= SHIFT, 900.0).otherwise(0.0)).withColumn("event_type", F.lit("all"))
    return timeseries.change_points(shifted, ["event_type"], "bucket", "actual", 4 * HOUR)


@query(f"SELECT 'all' AS event_type, 'level_shift' AS kind, CAST({SHIFT} AS BIGINT) AS bucket FROM events LIMIT 1")
def series_changes(spark, sf_dir):
    """The kind and place of a planted level shift."""
    return changes(spark, sf_dir).select("event_type", "kind", "bucket")


@query()
def series_segments(spark, sf_dir):
    return timeseries.segments(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", HOUR)


@query()
def series_forecast(spark, sf_dir):
    return timeseries.forecast(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", HOUR, 2 * X.DAY)


@query("WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders) SELECT CAST(day(d) AS INTEGER) AS feature, count(*) AS n, count(*) FILTER (WHERE abs(o_totalprice) > 300000) AS large FROM e GROUP BY 1")
def calendar_errors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("feature", X.calendar_features("o_orderdate")["day_of_month"])
    return timeseries.calendar_test(o, "feature", "o_totalprice", 300_000)


@query(
    "SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS day_of_month, CAST(date_diff('day', CAST(o_orderdate AS DATE), last_day(CAST(o_orderdate AS DATE))) AS INTEGER) AS days_before_end, CAST(dayofweek(o_orderdate) AS INTEGER) AS day_of_week, CAST(floor((day(o_orderdate) - 1) / 7) AS INTEGER) + 1 AS nth_weekday, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), last_day(CAST(o_orderdate AS DATE))) / 7) AS INTEGER) AS nth_weekday_before_end FROM orders"
)
def calendar_features(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("int").alias(n) for n, c in X.calendar_features("o_orderdate").items()])


# --- statistics and scalar functions -----------------------------------------------------------


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_extendedprice), 4) + 0.0 AS mean, round(var_samp(l_quantity), 6) + 0.0 AS variance, round(var_pop(l_quantity), 6) + 0.0 AS variance_pop, round(covar_pop(l_quantity, l_tax), 6) + 0.0 AS covariance FROM lineitem GROUP BY 1")
def central_moments(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("l_quantity").alias("n"), F.avg("l_extendedprice").alias("mean"), F.var_samp("l_quantity").alias("variance"), F.var_pop("l_quantity").alias("variance_pop"), F.covar_pop("l_quantity", "l_tax").alias("covariance"))
    return rounded(rounded(g, "mean", places=4), "variance", "variance_pop", "covariance")


@query("WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, round(any_value(m), 6) + 0.0 AS median, round(median(abs(c_acctbal - m)), 6) + 0.0 AS mad FROM customer JOIN m USING (c_mktsegment) GROUP BY 1")
def median_and_mad(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    m = c.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("median"))
    return rounded(c.join(m, "c_mktsegment").groupBy("c_mktsegment").agg(F.first("median").alias("median"), F.median(F.abs(F.col("c_acctbal") - F.col("median"))).alias("mad")), "median", "mad")


@query("SELECT l_returnflag, max_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS priciest, min(l_extendedprice) AS cheapest FROM lineitem GROUP BY 1")
def order_statistics(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max_by("l_orderkey", F.col("l_extendedprice") * 1000000 + F.col("l_orderkey")).alias("priciest"), F.min("l_extendedprice").alias("cheapest"))


@query("SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS quantile, round(unnest(quantile_cont(c_acctbal, [0.05, 0.25, 0.5, 0.75, 0.95])), 6) + 0.0 AS value, 'c_acctbal' AS \"column\" FROM customer")
def column_quantiles(spark, sf_dir):
    return rounded(frame.quantiles(read(spark, sf_dir, "customer"), ["c_acctbal"], [0.05, 0.25, 0.5, 0.75, 0.95]), "value")


@query("SELECT 'p_size' AS \"column\", bool_and(p_size = floor(p_size)) AS integral, bool_and(p_size >= 0) AS non_negative, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, count(*) FILTER (WHERE p_size IS NULL) AS missing FROM part UNION ALL SELECT 'p_retailprice', bool_and(p_retailprice = floor(p_retailprice)), bool_and(p_retailprice >= 0), min(p_retailprice), max(p_retailprice), count(*) FILTER (WHERE p_retailprice IS NULL) FROM part")
def column_types(spark, sf_dir):
    return frame.column_types(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) + 0.0 AS c_acctbal FROM customer")
def standardised(spark, sf_dir):
    return rounded(frame.standardise(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal")


@query("SELECT p_brand AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 9) + 0.0 AS frequency FROM part GROUP BY 1")
def category_frequencies(spark, sf_dir):
    return rounded(frame.category_frequencies(read(spark, sf_dir, "part"), "p_brand"), "frequency", places=9)


@query("SELECT p_brand AS category, count(*) AS n, round(avg(p_retailprice), 6) + 0.0 AS target_mean FROM part GROUP BY 1")
def category_target_means(spark, sf_dir):
    return rounded(frame.target_means(read(spark, sf_dir, "part"), "p_brand", "p_retailprice"), "target_mean")


@query("SELECT p_partkey, round((SELECT avg(q.p_retailprice) FROM part q WHERE q.p_type = p.p_type), 6) + 0.0 AS p_type_target_mean FROM part p")
def encoded_categories(spark, sf_dir):
    return rounded(frame.encode_category(read(spark, sf_dir, "part"), "p_type", "target_mean", "p_retailprice").select("p_partkey", "p_type_target_mean"), "p_type_target_mean")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    return frame.folds(read(spark, sf_dir, "labels"), "quality", 5, ["doc_id"], False).select("doc_id", "fold")


@query()
def stratified_sample(spark, sf_dir):
    return frame.stratified_sample(read(spark, sf_dir, "lineitem"), "l_returnflag", 0.1, "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query()
def feature_relevance(spark, sf_dir):
    return frame.relevance(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query(
    "WITH r AS (SELECT o_orderpriority, o_totalprice AS y, epoch(o_orderdate) / 86400 AS x FROM orders), a AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM r), "
    "u AS (SELECT o_orderpriority, y, (x - m) / s AS u, ((x - m) / s) ** 2 AS q, m, s FROM r, a), g AS (SELECT o_orderpriority, any_value(m) AS m, any_value(s) AS s, var_pop(u) AS uu, var_pop(q) AS qq, covar_pop(u, q) AS uq, covar_pop(y, u) AS yu, covar_pop(y, q) AS yq, regr_slope(y, u) / any_value(s) AS slope FROM u GROUP BY 1), "
    "c AS (SELECT *, (yq - yu * uq / uu) / (qq - uq * uq / uu) AS c2 FROM g) SELECT o_orderpriority, round(slope, 4) + 0.0 AS slope, round((yu - c2 * uq) / uu / s - 2 * c2 * m / (s * s), 2) + 0.0 AS linear, round(c2 / (s * s), 5) + 0.0 AS square FROM c"
)
def online_regression(spark, sf_dir):
    """Prices over days by priority: a line, and a parabola from moments."""
    o = read(spark, sf_dir, "orders").withColumn("x", X.epoch("o_orderdate") / 86400)
    line = o.groupBy("o_orderpriority").agg(F.regr_slope("o_totalprice", "x").alias("slope"))
    out = line.join(frame.quadratic_fit(o, ["o_orderpriority"], "x", "o_totalprice"), "o_orderpriority").select("o_orderpriority", "slope", "linear", "square")
    return rounded(rounded(rounded(out, "slope", places=4), "linear", places=2), "square", places=5)


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, levenshtein(c_mktsegment, 'BUILDING') AS distance, regexp_extract(c_name, '([0-9]+)', 1) AS digits, len(string_split(c_name, '#')) AS parts FROM customer")
def string_functions(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("low"), F.upper("c_mktsegment").alias("up"), F.levenshtein("c_mktsegment", F.lit("BUILDING")).cast("long").alias("distance"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"), F.size(F.split("c_name", "#")).cast("long").alias("parts"))


@query()
def text_similarity(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    a, b = F.col("c_name"), F.concat("c_mktsegment", F.lit(" "), "c_name")
    return c.select("c_custkey", TX.common_substring(a, b).alias("substring"), TX.common_subsequence(a, b).alias("subsequence"), TX.similarity_by_compression(a, b).alias("compression"), TX.levenshtein_similarity(a, b).alias("edit"))


@query("WITH a AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY 1) SELECT user_id, round(len(list_intersect(s, ['click', 'error', 'view'])) / len(list_distinct(list_concat(s, ['click', 'error', 'view']))), 9) + 0.0 AS jaccard FROM a")
def set_similarity(spark, sf_dir):
    a = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return rounded(a.select("user_id", X.jaccard(F.col("s"), F.array(F.lit("click"), F.lit("error"), F.lit("view"))).alias("jaccard")), "jaccard", places=9)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT p_partkey, round(p_size * 0.5 + p_retailprice * 0.25, 6) + 0.0 AS weighted_sum, round(1 / (1 + exp(-(p_size * 0.02 - p_retailprice * 0.001))), 9) + 0.0 AS logistic FROM part")
def inference_aggregation(spark, sf_dir):
    v = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    out = read(spark, sf_dir, "part").select("p_partkey", boost.aggregate_inference(v, "weighted_sum", [0.5, 0.25]).alias("weighted_sum"), boost.aggregate_inference(v, "logistic_regression", [0.02, -0.001]).alias("logistic"))
    return rounded(rounded(out, "weighted_sum"), "logistic", places=9)


@query(f"WITH h AS ({HOURLY}) SELECT bucket AS timestamp, max(actual) AS anomaly_score, count(*) AS record_count, {HOUR} AS bucket_span, FALSE AS is_interim FROM h GROUP BY 1")
def bucket_results(spark, sf_dir):
    return writers.bucket_results(hourly(spark, sf_dir), "bucket", HOUR, "actual")


@query(
    "WITH g AS (SELECT c_acctbal, count(*) FILTER (WHERE c_nationkey % 2 = 0) AS a, count(*) FILTER (WHERE c_nationkey % 2 = 1) AS b FROM customer GROUP BY 1), c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM g WINDOW w AS (ORDER BY c_acctbal ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(ca / ta - cb / tb)), 9) + 0.0 AS distance FROM c"
)
def ks_distance(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("odd", F.pmod("c_nationkey", F.lit(2)))
    return rounded(frame.ks_distance(c, "odd", "c_acctbal"), "distance", places=9)


@query()
def sketches(spark, sf_dir):
    return frame.sketches(read(spark, sf_dir, "events"), "event_type", "value", "user_id")


@query()
def item_sketch(spark, sf_dir):
    return frame.item_counts(read(spark, sf_dir, "events"), "user_id")


@query(
    f"WITH v AS (SELECT {BUCKET} AS bucket, CAST(user_id AS VARCHAR) AS person, count(*) AS value FROM events GROUP BY 1, 2), l AS (SELECT person FROM v GROUP BY 1 HAVING max(bucket) >= (SELECT max(bucket) FROM v) - 43200) SELECT v.bucket, v.person, v.value FROM v JOIN l USING (person)"
)
def pruned_persons(spark, sf_dir):
    v = features.feature_values(read(spark, sf_dir, "events"), Detector("non_zero_count", by="user_id"), "ts", HOUR)
    return features.prune_persons(v, 43_200).select("bucket", "person", "value")


@query()
def change_annotations(spark, sf_dir):
    return writers.annotations(changes(spark, sf_dir), ["event_type"], "bucket")


@query("SELECT count(DISTINCT event_type) AS total_models, CAST(count(*) AS BIGINT) AS total_rows FROM events")
def model_sizes(spark, sf_dir):
    return writers.size_stats(read(spark, sf_dir, "events"), ["event_type"])


# --- categorization ----------------------------------------------------------------------------


@query()
def message_categories(spark, sf_dir):
    m = messages(spark, sf_dir)
    return categorize.categorize(m, "id", "text", ["id"], partition="role")


def messages(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


@query()
def category_definitions(spark, sf_dir):
    m = messages(spark, sf_dir)
    return categorize.category_definitions(categorize.categorize(m, "id", "text", ["id"], partition="role"), m, "id", "text")


@query()
def category_counts(spark, sf_dir):
    """Messages enriched with their category, then counted by it: a categorizer in front of a detector."""
    m = messages(spark, sf_dir)
    c = categorize.categorize(m, "id", "text", ["id"], partition="role")
    rows = m.join(c.select(F.col("key").alias("id"), F.concat_ws(":", "partition", "category").alias("mlcategory")), "id")
    return features.feature_values(rows.withColumn("ts", F.timestamp_seconds("id")), Detector("count", by="mlcategory", partition="role"), "ts", 100_000)


@query("WITH c AS (SELECT event_type AS category, count(*) AS count FROM events GROUP BY 1) SELECT CAST(sum(count) AS BIGINT) AS messages, count(*) AS categories, count(*) FILTER (WHERE count = 1) AS rare, count(*) FILTER (WHERE count > 1 AND count * 100 > (SELECT sum(count) FROM c)) AS frequent, 'ok' AS status FROM c")
def categorization_status(spark, sf_dir):
    c = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return categorize.categorization_status(c).withColumn("frequent", F.col("frequent").cast("long"))


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?s)^.*?the.+?and.*$')")
def reverse_search(spark, sf_dir):
    c = categorize.Category(["the", "and"], [1, 1])
    return read(spark, sf_dir, "conversations").where(F.col("text").rlike("(?s)^" + c.reverse_search()[1] + "$")).select("conv_id", "turn")


# --- batch analyses ----------------------------------------------------------------------------

KNN = (
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings), d AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, array_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 5)"
)


def knn(spark, sf_dir):
    return outliers.neighbours(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


@query(f"{KNN} SELECT key, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) + 0.0 AS distance FROM k")
def nearest_neighbours(spark, sf_dir):
    return rounded(knn(spark, sf_dir), "distance")


@query(f"{KNN} SELECT key, round(max(distance), 6) + 0.0 AS score FROM k GROUP BY 1")
def outliers_distance_kth_nn(spark, sf_dir):
    return rounded(outliers.distance_kth_nn(knn(spark, sf_dir)), "score")


@query(f"{KNN} SELECT key, round(avg(distance), 6) + 0.0 AS score FROM k GROUP BY 1")
def outliers_distance_knn(spark, sf_dir):
    return rounded(outliers.distance_knn(knn(spark, sf_dir)), "score")


@query(
    f"{KNN}, kd AS (SELECT key, max(distance) AS kd FROM k GROUP BY 1), r AS (SELECT k.key, k.neighbour, greatest(k.distance, kd.kd) AS reach FROM k JOIN kd ON k.neighbour = kd.key), m AS (SELECT key, avg(reach) AS reach FROM r GROUP BY 1), l AS (SELECT key, CASE WHEN reach > 0 THEN 1 / reach ELSE coalesce(2 / (SELECT min(reach) FROM m WHERE reach > 0), 1) END AS lrd FROM m) "
    "SELECT k.key, round(avg(n.lrd) / any_value(o.lrd), 6) + 0.0 AS score FROM k JOIN l n ON k.neighbour = n.key JOIN l o ON k.key = o.key GROUP BY 1"
)
def outliers_lof(spark, sf_dir):
    return rounded(outliers.lof(knn(spark, sf_dir)), "score")


@query(
    f"{KNN}, o AS (SELECT key, avg(distance) AS o FROM k GROUP BY 1), i AS (SELECT a.key, sum(array_distance(x.e, y.e)) / 20 AS i FROM k a JOIN k b ON a.key = b.key JOIN v x ON x.vec_id = a.neighbour JOIN v y ON y.vec_id = b.neighbour GROUP BY 1) "
    "SELECT key, round(o / greatest(i, 1e-12), 6) + 0.0 AS score FROM o JOIN i USING (key)"
)
def outliers_ldof(spark, sf_dir):
    return rounded(outliers.ldof(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", knn(spark, sf_dir)), "score")


@query()
def outliers_ensemble(spark, sf_dir):
    return outliers.ensemble(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", influence=True)


@query(
    f"WITH h AS (SELECT {BUCKET} AS bucket, event_type, sum(value) AS v FROM events GROUP BY 1, 2) SELECT a.event_type AS a, b.event_type AS b, round(corr(a.v, b.v), 6) + 0.0 AS correlation FROM h a JOIN h b ON a.bucket = b.bucket AND a.event_type < b.event_type GROUP BY 1, 2"
)
def correlated_pairs(spark, sf_dir):
    h = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket"), "event_type").agg(F.sum("value").alias("v"))
    b = h.select("bucket", F.col("event_type").alias("b"), F.col("v").alias("w"))
    pairs = h.withColumnRenamed("event_type", "a").join(b, "bucket").where("a < b").groupBy("a", "b").agg(F.corr("v", "w").alias("correlation"))
    return rounded(pairs, "correlation")


PRICE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query()
def regression(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    model = boost.train_regression(rows, PRICE, "l_extendedprice", trees=5, depth=4)
    return boost.predict_regression(model, rows, PRICE).select("k", "l_extendedprice", "prediction")


@query()
def regression_retrained(spark, sf_dir):
    """A model of small parts, stored and read back, two of whose trees are grown anew on all parts."""
    rows = read(spark, sf_dir, "part").withColumn("brand", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double"))
    model = trees.fit(rows.where("p_size <= 25"), ["p_size", "brand"], "p_retailprice", p=trees.Parameters(trees=4, depth=3))
    again = trees.retrain(trees.read_model(model.to_json()), rows, "p_retailprice", 2, trees.Parameters(depth=3))
    return boost.predict_regression(again, rows, again.features).select("p_partkey", "p_retailprice", "prediction")


@query()
def regression_importance(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("brand", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double"))
    fs = ["p_size", "brand"]
    model = boost.train_regression(rows, fs, "p_retailprice", trees=5, depth=3)
    return boost.top_importances(boost.feature_importance(model, rows, "p_partkey", fs), fs, 1)


@query()
def classification(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "quality", "n_chars", F.length(F.regexp_replace("text", r"[\p{L}\s]", "")).alias("marks"), F.size(F.array_distinct(F.split("text", r"\s+"))).alias("kinds"), F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")).alias("capitals")
    )
    fs = ["n_chars", "marks", "kinds", "capitals"]
    fitted, classes = boost.train_classification(rows, fs, "quality", trees=5, depth=4)
    return boost.predict_classification(fitted, classes, rows, fs).select("doc_id", "quality", "prediction", "top_classes")


@query()
def k_means(spark, sf_dir):
    return cluster.k_means(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)


@query()
def x_means(spark, sf_dir):
    return cluster.x_means(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)[0]


@query("WITH v AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT (SELECT count(*)::DOUBLE FROM embeddings) AS points, round(sum(x), 6) + 0.0 AS total, round(sum(x * x), 6) + 0.0 AS squares FROM v")
def cluster_features(spark, sf_dir):
    """What features keep of all points, however they were merged."""
    f = online.features_of(read(spark, sf_dir, "embeddings"), "embedding", 128)
    total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    return rounded(f.agg(F.sum("n").alias("points"), F.sum(total).alias("total"), F.sum("q").alias("squares")), "total", "squares")


@query()
def online_x_means(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return online.nearest_centre(e, "vec_id", "embedding", online.x_centres(online.features_of(e, "embedding"), 6))


@query()
def bootstrap_clusters(spark, sf_dir):
    return online.bootstrap_clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, samples=20)


@query()
def seasonal_component(spark, sf_dir):
    """Each type's daily component, with buckets where its errors are."""
    return rounded(seasons.seasonal_component(planted(spark, sf_dir, season=400.0), ["event_type"], "bucket", "actual", X.DAY, buckets=8), "mean", "fitted")


@query()
def agglomerative(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.array(F.col("s_acctbal")).alias("v"))
    return cluster.agglomerative(s, "s_nationkey", "s_suppkey", "v", "ward")


@query()
def natural_breaks(spark, sf_dir):
    return cluster.break_columns(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", 4)


@query()
def random_projection(spark, sf_dir):
    return cluster.project(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query()
def inference_requests(spark, sf_dir):
    r = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.transform(F.split("text", " "), lambda w: F.crc32(w.cast("binary"))).alias("tokens"))

    def make():
        return lambda batch: [[float(len(t)), float(t.sum() % 97)] for t in batch]

    return inference.infer(r, "tokens", make).drop("time_ms", "cache_hit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from driftwell.plans import scoring  # noqa: F401  registers its queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from driftwell.plans import scoring  # noqa: F401  registers its queries here

    return dict(SQL)
