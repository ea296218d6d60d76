"""Queries from features to written results, with SQL that states special functions by their series."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from driftwell.functions import expressions as X
from driftwell.operators import categorize, cluster, features, frame, hierarchy, models, outliers, windows
from driftwell.plans.catalogue import BUCKET, HOUR, HOURLY, P_SQL, SCORE_SQL, flagship, hourly, part_probabilities, query, read, rounded
from driftwell.plans.config import Detector
from driftwell.sources import writers

# --- SQL for special functions -----------------------------------------------------------------


def erfc_sql(x: str) -> str:
    """1 less erf by its series of positive terms; x from 0 to about 5."""
    terms = f"list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest({x}, 1e-290)) + 2 * k * ln(2.0) + lgamma(k + 1) - lgamma(2 * k + 2)))"
    return f"(1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum({terms}))"


def deviations_sql(source: str, name: str) -> str:
    """Common tables that end in {name}: source's distinct p with z, where p is the chance of a normal value z or more out either way.

    Newton's steps from zero: the tail is convex, so they come from the left and stop at the root.
    """
    tail = f"({erfc_sql('z / sqrt(2.0)')} - p)"
    return (
        f"{name}_n(p, z, i) AS (SELECT DISTINCT p, 0.0::DOUBLE, 0 FROM {source} WHERE p IS NOT NULL UNION ALL "
        f"SELECT p, z + {tail} / (2 * exp(-z * z / 2) / sqrt(2 * pi())), i + 1 FROM {name}_n WHERE i < 40), "
        f"{name} AS (SELECT p, z FROM {name}_n WHERE i = 40)"
    )


def joint_sql(n: str, m: str, least: str) -> str:
    """Chi-squared tail of up to five samples, in closed form."""
    x = f"({m} / 2)"
    e = f"exp(-{x})"
    odd = f"{erfc_sql(f'sqrt({x})')}"
    return (
        f"CASE WHEN {m} / {n} < 1e-8 THEN 1.0 WHEN {n} = 1 THEN {least} WHEN {n} = 2 THEN {e} WHEN {n} = 4 THEN {e} * (1 + {x}) "
        f"WHEN {n} = 3 THEN {odd} + {e} * 2 * sqrt({x} / pi()) WHEN {n} = 5 THEN {odd} + {e} * 2 * sqrt({x} / pi()) * (1 + 2 * {x} / 3) END"
    )


# --- scores of sets ----------------------------------------------------------------------------

EXTREMES = (
    "list_min(list_transform(range(1, n + 1), lambda i: ln(list_sum(list_transform(range(i, n + 1), "
    "lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * pow(ps[i], k) * pow(1 - ps[i], n - k))))))"
)
SET_SCORE = f"0.8 * (0.5 * (SELECT {SCORE_SQL} FROM (SELECT exp(lj) AS p)) + 0.5 * (SELECT {SCORE_SQL} FROM (SELECT exp(le) AS p)))"
FROM_SCORE = "CASE WHEN s / 0.8 <= 1 THEN 1 / (20 + s / 0.8 * (1e4 - 20)) ELSE exp(ln(1e-4) - (s / 0.8 - 1) / 49 * (ln(1e-4) - ln(1e-50))) END"


@query(
    f"WITH RECURSIVE l AS (SELECT {BUCKET} AS bucket, event_type, 1 / (1 + sum(value) / 50) AS p FROM events GROUP BY 1, 2), {deviations_sql('l', 'd')}, "
    "g AS (SELECT bucket, count(*) AS n, sum(z * z) AS m, list(p ORDER BY p) AS ps FROM l JOIN d USING (p) GROUP BY 1), "
    f"e AS (SELECT bucket, n, ln({joint_sql('n', 'm', 'ps[1]')}) AS lj, {EXTREMES} AS le FROM g), "
    f"o AS (SELECT bucket, n, exp(0.5 * lj + 0.5 * le) AS plain, CASE WHEN least(lj, le) > ln(0.035) THEN 0.0 ELSE {SET_SCORE} END AS s FROM e) "
    f"SELECT bucket, n, round(s, 6) + 0.0 AS score, round(CASE WHEN s > 0 THEN {FROM_SCORE} ELSE plain END, 6) + 0.0 AS probability FROM o"
)
def joint_scores(spark, sf_dir):
    leaves = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket"), "event_type").agg((1 / (1 + F.sum("value") / 50)).alias("p"))
    return rounded(hierarchy.combined(leaves, ["bucket"], "p", "attributes"), "score", "probability")


FEATURES_SQL = (
    f"h AS (SELECT {BUCKET} AS bucket, event_type, CAST(user_id AS VARCHAR) AS person, 1 / (1 + sum(value) / 400) AS p1, 1 / (1 + count(*) / 2.0) AS p2 FROM events GROUP BY 1, 2, 3), "
    "n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), c AS (SELECT a.event_type, sum(b.n) / (SELECT sum(n) FROM n) AS c FROM n a JOIN n b ON b.n <= a.n GROUP BY 1), "
)


def feature_rows(spark, sf_dir):
    """(bucket, event_type, person, p, c): two features' probabilities a row, and the share of events of no commoner types."""
    e = read(spark, sf_dir, "events")
    h = e.groupBy(X.bucket_of("ts", HOUR).alias("bucket"), "event_type", F.col("user_id").cast("string").alias("person")).agg(
        F.array(1 / (1 + F.sum("value") / 400), 1 / (1 + F.count(F.lit(1)) / 2)).alias("ps")
    )
    c = hierarchy.category_probability(e, [], "event_type").select("event_type", F.col("probability").alias("c"))
    return h.join(F.broadcast(c), "event_type").select("bucket", "event_type", "person", F.explode("ps").alias("p"), "c")  # a row a type


EACH_SQL = (
    f"WITH RECURSIVE {FEATURES_SQL}f AS (SELECT p1 AS p FROM h UNION ALL SELECT p2 FROM h), {deviations_sql('f', 'd')}, "
    "j AS (SELECT h.*, c, exp(-(a.z * a.z + b.z * b.z) / 2) AS joint, 1 - (1 - least(p1, p2)) ** 2 AS extreme FROM h JOIN d a ON a.p = p1 JOIN d b ON b.p = p2 JOIN c USING (event_type)), "
    f"q AS (SELECT least(joint, extreme) AS p FROM j UNION ALL SELECT c FROM c), {deviations_sql('q', 'v')}, "
    "r AS (SELECT j.bucket, j.event_type, j.person, joint, extreme, exp(-(a.z * a.z + b.z * b.z) / 2) AS probability FROM j JOIN v a ON a.p = least(joint, extreme) JOIN v b ON b.p = j.c)"
)


@query(f"{EACH_SQL} SELECT bucket, event_type, person, 2::BIGINT AS n, round(joint, 6) + 0.0 AS joint, round(extreme, 6) + 0.0 AS extreme, round(probability, 6) + 0.0 AS probability FROM r")
def features_combined(spark, sf_dir):
    """A detector's features joined, then with the category's probability."""
    return rounded(hierarchy.features_combined(feature_rows(spark, sf_dir), ["bucket", "event_type", "person"], "p", "c"), "joint", "extreme", "probability")


@query(
    f"{EACH_SQL}, t AS (SELECT probability AS p FROM r), {deviations_sql('t', 'w')}, g AS (SELECT bucket, person, count(*) AS n, sum(z * z) AS m, min(p) AS least FROM r JOIN w ON w.p = r.probability GROUP BY 1, 2) "
    f"SELECT bucket, person, n, round({joint_sql('n', 'm', 'least')}, 6) + 0.0 AS probability FROM g"
)
def population_combined(spark, sf_dir):
    """Persons of a population: attributes' features and category probabilities, then all attributes together."""
    return rounded(hierarchy.population_combined(feature_rows(spark, sf_dir), ["bucket", "person"], "event_type", "p", "c"), "probability")


LEAVES = f"l AS (SELECT {BUCKET} AS bucket, event_type AS part, CAST(user_id AS VARCHAR) AS person, 1 / (1 + sum(value)) AS p FROM events GROUP BY 1, 2, 3)"


@query(
    f"WITH {LEAVES}, g AS (SELECT bucket, part, person, CASE WHEN grouping(person) = 0 THEN 'person' WHEN grouping(part) = 0 THEN 'partition' ELSE 'root' END AS level, count(*) AS n, min(p) AS least FROM l GROUP BY GROUPING SETS ((bucket, part, person), (bucket, part), (bucket))) "
    "SELECT bucket, part AS partition, person, level, n, round(least, 12) + 0.0 AS least FROM g WHERE least(least, 1 - pow(1 - least, n)) < 0.035"
)
def written_results(spark, sf_dir):
    """Nodes of the hierarchy whose own or least descendant's probability is unusual."""
    leaves = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", HOUR).alias("bucket"), F.col("event_type").alias("part"), F.col("user_id").cast("string").alias("person")).agg((1 / (1 + F.sum("value"))).alias("p"))
    levels = hierarchy.level_summaries(leaves, "bucket", "part", "person", "p")
    return rounded(hierarchy.written(levels).select("bucket", "partition", "person", "level", "n", "least"), "least", places=12)


def knots_sql(q: str) -> str:
    steps = " ".join(f"WHEN {q} <= {x1} THEN {y0} + ({q} - {x0}) / ({x1} - {x0}) * ({y1} - {y0})" for (x0, y0), (x1, y1) in zip(hierarchy.KNOTS, hierarchy.KNOTS[1:]))
    return f"(CASE {steps} ELSE 100.0 END)"


@query(
    f"WITH s AS (SELECT p_partkey, p_brand, {SCORE_SQL} AS s FROM ({P_SQL.replace('p_partkey,', 'p_partkey, p_brand,')})), "
    "k AS (SELECT *, count(*) OVER b AS total, max(s) OVER b AS largest, 100.0 * (rank() OVER o - 1) / count(*) OVER b AS lo, 100.0 * cume_dist() OVER o AS hi, sum(CASE WHEN s <= 0 THEN 1 ELSE 0 END) OVER b / count(*) OVER b AS zero FROM s WINDOW b AS (PARTITION BY p_brand), o AS (PARTITION BY p_brand ORDER BY s)), "
    "f AS (SELECT *, min(CASE WHEN hi >= 50 - 1e-9 THEN s END) OVER (PARTITION BY p_brand) AS noise, CASE WHEN s <= 1 THEN ln(1 / (20 + s * (1e4 - 20))) WHEN s <= 50 THEN ln(1e-4) - (s - 1) / 49 * (ln(1e-4) - ln(1e-50)) ELSE ln(1e-50) - (s - 50) / 50 * (ln(1e-50) - ln(2.2250738585072014e-308)) END AS lp FROM k) "
    "SELECT p_partkey, round(CASE WHEN s <= 0 THEN 0.0 ELSE least(1.0 * greatest(1 + 10 * (s - noise), 0.0) + 100 * greatest(2 * least(2 * zero, 1.0) - 1, 0.0), "
    f"({knots_sql('lo')} + {knots_sql('hi')}) / 2, 100 * least(1.5 * s / largest, 0.5 + 0.5 * s / largest), 100 * (0.95 * (lp - ln(0.05)) / (ln(1e-4) - ln(0.05)) + 0.05), 100.0) END, 6) + 0.0 AS normalised FROM f"
)
def normaliser_ceilings(spark, sf_dir):
    s = part_probabilities(spark, sf_dir).withColumn("s", X.anomaly_score("p"))
    return rounded(hierarchy.ceilings(s, ["p_brand"], "s").select("p_partkey", "normalised"), "normalised")


INFLUENCE = (
    f"WITH e AS (SELECT {BUCKET} AS bucket, event_type, user_id, value FROM events), a AS (SELECT bucket, event_type, sum(value) AS s FROM e GROUP BY 1, 2), b AS (SELECT bucket, event_type, user_id, sum(value) AS s2 FROM e GROUP BY 1, 2, 3), "
    "i AS (SELECT bucket, event_type, user_id, greatest(0.0, least(1.0, 1 - (-(s - s2)) / least(-s, -1e-12))) AS influence FROM a JOIN b USING (bucket, event_type))"
)


@query(f"{INFLUENCE} SELECT bucket, event_type, user_id, round(influence, 6) + 0.0 AS influence FROM i WHERE influence + 1.23e-8 >= 0.4")
def influence_cutoff(spark, sf_dir):
    """Influencers of at least 0.4, the others left out of results."""
    e = read(spark, sf_dir, "events").select(X.bucket_of("ts", HOUR).alias("bucket"), "event_type", "user_id", "value")
    a = e.groupBy("bucket", "event_type").agg(F.sum("value").alias("s"))
    out = e.groupBy("bucket", "event_type", "user_id").agg(F.sum("value").alias("s2")).join(a, ["bucket", "event_type"])
    out = out.withColumn("influence", hierarchy.influence(-F.col("s"), -(F.col("s") - F.col("s2")), "without"))
    return rounded(out.where(F.col("influence") + 1.23e-8 >= hierarchy.INFLUENCE_CUTOFF).select("bucket", "event_type", "user_id", "influence"), "influence")


# --- scores of series --------------------------------------------------------------------------

TRAILING = (
    "SELECT *, avg(value) OVER w AS typical, stddev_samp(value) OVER w AS spread, (value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 1e-3) AS z FROM v "
    "WINDOW w AS (PARTITION BY person ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
)
BOTH_TAILS = "(SELECT t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) FROM (SELECT 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t))"

query(
    f"WITH e AS (SELECT {BUCKET} AS bucket, event_type AS person FROM events), c AS (SELECT bucket, person, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT person, min(bucket) AS f FROM c GROUP BY 1), "
    f"g AS (SELECT person, unnest(range(f, (SELECT max(bucket) FROM c) + 1, {HOUR})) AS bucket FROM k), v AS (SELECT g.bucket, g.person, coalesce(n, 0)::DOUBLE AS value FROM g LEFT JOIN c ON c.bucket = g.bucket AND c.person = g.person), "
    f"t AS ({TRAILING}), p AS (SELECT bucket, person, value AS actual, typical, CASE WHEN z IS NULL THEN 1.0 WHEN z > 0 THEN greatest({BOTH_TAILS} / 2, 2.2250738585072014e-308) ELSE 0.5 END AS p FROM t), "
    f"s AS (SELECT *, {SCORE_SQL} AS s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(p, 12), person) AS rank FROM s) "
    "SELECT bucket, person, actual, round(typical, 6) + 0.0 AS typical, round(p, 6) + 0.0 AS probability, round(s, 6) + 0.0 AS score, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'major' WHEN s >= 25 THEN 'minor' ELSE 'warning' END AS severity, rank FROM r WHERE rank <= 3"
)(flagship)


@query(f"WITH v AS (SELECT bucket, event_type AS person, actual AS value FROM ({HOURLY})), t AS ({TRAILING}) SELECT person AS event_type, bucket, round(typical - 1.96 * coalesce(spread, 0.0), 6) + 0.0 AS model_lower, round(typical + 1.96 * coalesce(spread, 0.0), 6) + 0.0 AS model_upper, round(typical, 6) + 0.0 AS model_median, round(value, 6) + 0.0 AS actual FROM t")
def model_plot(spark, sf_dir):
    scored = windows.trailing_score(hourly(spark, sf_dir), ["event_type"], "bucket", "actual")
    return rounded(writers.model_plot(scored, ["event_type"], "bucket"), "model_lower", "model_upper", "model_median", "actual")


@query(
    f"WITH d AS (SELECT {BUCKET.replace(str(HOUR), '86400')} AS bucket, user_id, sum(value) AS v FROM events GROUP BY 1, 2), "
    "p AS (SELECT x.user_id AS a, y.user_id AS b, corr(x.v, y.v) AS correlation FROM d x JOIN d y ON x.bucket = y.bucket AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) > 2) "
    "SELECT a, b, round(correlation, 6) + 0.0 AS correlation FROM p WHERE NOT isnan(correlation) ORDER BY abs(correlation) DESC, a, b LIMIT 10"
)
def most_correlated(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy(X.bucket_of("ts", X.DAY).alias("bucket"), "user_id").agg(F.sum("value").alias("v"))
    return rounded(outliers.most_correlated(d, "user_id", "bucket", "v"), "correlation")


@query(
    "WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label AS c, i, avg(x) AS m, var_pop(x) AS d FROM v GROUP BY 1, 2), "
    "w AS (SELECT c, i, m, d + 1e-9 * (SELECT max(d) FROM (SELECT var_pop(x) AS d FROM v GROUP BY i)) AS d FROM s), n AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1), "
    "l AS (SELECT vec_id, label, c, ln(any_value(n)) - 0.5 * sum(ln(d) + (x - m) ** 2 / d) AS l FROM v JOIN w USING (i) JOIN n USING (c) GROUP BY ALL) "
    "SELECT vec_id, label, c::DOUBLE AS prediction FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, c) = 1"
)
def naive_bayes(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return cluster.naive_bayes(e, "embedding", "label").transform(rows).select("vec_id", "label", "prediction")


# --- offsets, times and buckets ----------------------------------------------------------------


@query(f"SELECT {BUCKET} AS bucket, event_type AS person, count(*) AS value, count(*) - 1 AS modelled, greatest(round(0.5 * (count(*) - 1), 6) + 1, 0.0) AS displayed FROM events GROUP BY 1, 2")
def count_offsets(spark, sf_dir):
    """Counts that start at one as models hold them, and half of the modelled value as it would be shown."""
    v = features.feature_values(read(spark, sf_dir, "events"), Detector("high_non_zero_count", by="event_type"), "ts", HOUR).select("bucket", "person", "value")
    v = v.withColumn("modelled", features.modelled("value", "high_non_zero_count"))
    return v.withColumn("displayed", features.displayed(0.5 * F.col("modelled"), "high_non_zero_count"))


@query(f"SELECT {BUCKET} AS bucket, event_type AS person, round(avg(floor(epoch(ts))), 4) + 0.0 AS measured, {BUCKET} + {HOUR // 2}.0::DOUBLE AS middle FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def sample_times(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a = features.sample_times(e, Detector("mean", "value", by="event_type"), "ts", HOUR).select("bucket", "person", F.col("time").alias("measured"))
    b = features.sample_times(e, Detector("count", by="event_type"), "ts", HOUR).select("bucket", "person", F.col("time").alias("middle"))
    return rounded(a.join(b, ["bucket", "person"]), "measured", places=4)


@query(f"SELECT event_id FROM events WHERE epoch(ts) >= (SELECT floor(min(floor(epoch(ts))) / {HOUR}) * {HOUR} + {HOUR} - 600 FROM events)")
def first_bucket(spark, sf_dir):
    """Rows that a restored job reads: its first, partly seen bucket is skipped."""
    return features.whole_buckets(read(spark, sf_dir, "events"), "ts", HOUR, 600, restored=True).select("event_id")


@query(
    "WITH t AS (SELECT p_partkey, 1 / (1 + exp(-(p_size - 25.0) / 5.0)) AS a, 1 / (1 + exp(-(p_retailprice - 1000.0) / 200.0)) AS b FROM part) "
    "SELECT p_partkey, round(a * b, 9) + 0.0 AS both, round(1 - (1 - a) * (1 - b), 9) + 0.0 AS either FROM t"
)
def fuzzy_truth(spark, sf_dir):
    a, b = X.fuzzy_above("p_size", 25.0, 5.0), X.fuzzy_above("p_retailprice", 1000.0, 200.0)
    return rounded(read(spark, sf_dir, "part").select("p_partkey", X.fuzzy_and(a, b).alias("both"), X.fuzzy_or(a, b).alias("either")), "both", "either", places=9)


@query(
    "SELECT p_partkey, substr(p_type, 1, 1) AS \"p_type.10\", substr(p_type, 2, 1) AS \"p_type.11\", substr(p_type, 1, 2) AS \"p_type.20\", (p_brand = 'Brand#13')::INTEGER AS is_13, "
    "CASE p_size WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0.125 END AS size_share, CASE substr(p_type, 1, 2) WHEN 'ST' THEN 7.5 ELSE 1.5 END AS type_mean FROM part"
)
def custom_processors(spark, sf_dir):
    chain = [{"kind": "n_gram", "field": "p_type", "length": 2, "n_grams": [1, 2]}, {"kind": "target_mean", "field": "`p_type.20`", "table": {"ST": 7.5}, "default": 1.5, "column": "type_mean"}]
    out = frame.preprocessed(
        read(spark, sf_dir, "part"),
        [
            {"kind": "multi", "processors": chain},
            {"kind": "one_hot", "field": "p_brand", "values": {"Brand#13": "is_13"}},
            {"kind": "frequency", "field": "p_size", "table": {"1": 0.25, "2": 0.5}, "default": 0.125, "column": "size_share"},
        ],
    )
    return out.select("p_partkey", "`p_type.10`", "`p_type.11`", "`p_type.20`", "is_13", "size_share", "type_mean")


@query("WITH t AS (SELECT conv_id, turn, unnest(string_split(replace(text, ' ', ','), ',')) AS token FROM conversations) SELECT token, count(*) AS n FROM t WHERE token <> '' AND NOT contains(token, '\"') GROUP BY 1")
def pretokenised(spark, sf_dir):
    """Tokens that came ready as values between commas, counted."""
    lines = read(spark, sf_dir, "conversations").select(F.replace("text", F.lit(" "), F.lit(",")).alias("line"))
    return lines.select(F.explode(categorize.tokens_of_csv(F.col("line"))).alias("token")).where(~F.contains("token", F.lit('"'))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN regexp_matches(text, '\\d') THEN 0 WHEN regexp_matches(text, '[?!]') THEN 1 WHEN regexp_matches(text, '^[A-Z]') THEN 2 ELSE -1 END AS pattern, count(*) AS n, min(length(text))::INTEGER AS least, max(length(text))::INTEGER AS most FROM conversations GROUP BY 1")
def pattern_counts(spark, sf_dir):
    return categorize.pattern_counts(read(spark, sf_dir, "conversations"), "text", ["\\d", "[?!]", "^[A-Z]"])


# --- priors, parts of the week, summaries ------------------------------------------------------


@query(
    "WITH m AS (SELECT p_brand, count(*) AS n, avg(p_size) AS x, avg(p_retailprice) AS y, count(*) * var_pop(p_size) AS xx, count(*) * covar_pop(p_size, p_retailprice) AS xy, count(*) * var_pop(p_retailprice) AS yy FROM part GROUP BY 1), "
    "d AS (SELECT p_partkey, n, ((p_size - x) ** 2 * yy - 2 * (p_size - x) * (p_retailprice - y) * xy + (p_retailprice - y) ** 2 * xx) / (xx * yy - xy * xy) * n / (n + 1) AS far FROM part JOIN m USING (p_brand)) "
    "SELECT p_partkey, round(exp(-(n - 2) / 2.0 * ln(1 + far)), 7) + 0.0 AS probability FROM d"
)
def pair_probabilities(spark, sf_dir):
    """Size and price of every part under its brand's normal model of two variables."""
    p = models.pair_probabilities(read(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice")
    return rounded(p.select("p_partkey", "probability"), "probability", places=7)


@query(
    "WITH m AS (SELECT p_brand, count(*) AS n, avg(p_size) AS x, avg(p_retailprice) AS y, count(*) * var_pop(p_size) AS xx, count(*) * covar_pop(p_size, p_retailprice) AS xy, count(*) * var_pop(p_retailprice) AS yy FROM part GROUP BY 1), "
    "d AS (SELECT p_partkey, n, ((p_size - x) ** 2 * yy - 2 * (p_size - x) * (p_retailprice - y) * xy + (p_retailprice - y) ** 2 * xx) / (xx * yy - xy * xy) * n / (n + 1) AS far FROM part JOIN m USING (p_brand)) "
    "SELECT p_partkey, round(exp(-(n - 2) / 2.0 * ln(1 + far)), 7) + 0.0 AS probability FROM d"
)
def vector_probabilities(spark, sf_dir):
    """The normal model of any number of variables, here of two, for which SQL has a closed form."""
    p = models.vector_probabilities(read(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_retailprice"])
    return rounded(p.select("p_partkey", "probability"), "probability", places=7)


@query("SELECT l_orderkey, l_linenumber, first_value(l_tax) OVER w AS constant, CASE WHEN l_tax = first_value(l_tax) OVER w THEN 1.0 ELSE 0.0 END AS probability FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax)")
def constant_scores(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return rounded(models.constant_scores(lines, ["l_orderkey"], ["l_linenumber"], "l_tax").drop("l_tax"), "probability")


@query(f"WITH h AS ({HOURLY}) SELECT event_type, (bucket // 86400 + 3) % 7 >= 5 AS weekend, bucket % 86400 AS phase, round(avg(actual), 6) + 0.0 AS mean, count(actual) AS count FROM h GROUP BY 1, 2, 3")
def week_part_means(spark, sf_dir):
    return rounded(windows.week_part_means(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", X.DAY), "mean")


@query(
    f"WITH h AS ({HOURLY}), r AS (SELECT event_type, bucket % 86400 AS phase, actual, avg(actual) OVER (PARTITION BY event_type) AS a, avg(actual) OVER (PARTITION BY event_type, bucket % 86400) AS m FROM h), "
    "s AS (SELECT event_type, count(*) AS rows, count(DISTINCT phase) AS phases, sum((m - a) ** 2) AS b, sum((actual - m) ** 2) AS l FROM r GROUP BY 1) "
    "SELECT event_type, rows, phases, round((b + l) / rows, 5) + 0.0 AS variance, round(l / rows, 5) + 0.0 AS residual_variance, CASE WHEN l > 0 AND rows > phases THEN round(b / (phases - 1) / (l / (rows - phases)), 5) + 0.0 END AS f FROM s"
)
def seasonal_variance(spark, sf_dir):
    return rounded(windows.seasonal_variance(hourly(spark, sf_dir), ["event_type"], "bucket", "actual", X.DAY), "variance", "residual_variance", "f", places=5)


@query(
    """SELECT '{"num_columns":3,"column_names":["p_partkey","p_size","p_brand"],"column_is_categorical":[false,false,true]}' AS document UNION ALL """
    """SELECT '{"data":["' || p_partkey || '","' || p_size || '","' || p_brand || '"]}' FROM part"""
)
def data_summary(spark, sf_dir):
    return writers.data_summary(read(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_brand"], ["p_brand"])
