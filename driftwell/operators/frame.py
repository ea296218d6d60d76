"""Column statistics and encodings of a data frame for batch analyses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.windows import running_totals_by_value


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column less its mean, over its standard deviation; constant columns become zero."""
    stats = df.agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row on the right
    for i, c in enumerate(columns):
        z = F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.when(F.col(c).isNotNull(), 0.0))
        out = out.withColumn(c, z)
    return out.drop(*[f"_{n}{i}" for i in range(len(columns)) for n in "ms"])


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, integral, non_negative, low, high, missing), one row a column, from one aggregation."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.bool_and(v == F.floor(v)).alias("integral"),
                F.bool_and(v >= 0).alias("non_negative"),
                F.min(v).alias("low"),
                F.max(v).alias("high"),
                F.count_if(v.isNull()).alias("missing"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def quantiles(df: DataFrame, columns: list[str], at: list[float], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """(column, quantile, value): exact, or from a mergeable sketch."""
    f = (lambda c: F.percentile(c, at)) if exact else (lambda c: F.percentile_approx(c, at, accuracy))
    row = df.agg(*[f(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("x")).select(
        F.col("x.column").alias("column"), F.posexplode("x.v").alias("i", "value")
    ).select("column", F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("quantile"), "value")


def category_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(category, n, frequency)."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_total")))).select("category", "n", (F.col("n") / F.col("_total")).alias("frequency"))  # one row


def target_means(df: DataFrame, column: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """(category, n, target_mean), drawn towards the mean of all by `smoothing` pseudo-rows."""
    g = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(column).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("_s")
    )
    if not smoothing:
        return g.select("category", "n", (F.col("_s") / F.col("n")).alias("target_mean"))
    prior = g.agg((F.sum("_s") / F.sum("n")).alias("_p"))
    return g.crossJoin(F.broadcast(prior)).select("category", "n", ((F.col("_s") + smoothing * F.col("_p")) / (F.col("n") + smoothing)).alias("target_mean"))  # one row


def encode_category(df: DataFrame, column: str, how: str, target: str | None = None, categories: int = 10) -> DataFrame:
    """df with the column's encoding: 'frequency', 'target_mean' or 'one_hot' of its commonest values and a rest."""
    if how == "one_hot":
        top = [r["category"] for r in category_frequencies(df, column).orderBy(F.desc("n"), "category").limit(categories).collect()]
        return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in top],
                         (~F.coalesce(F.col(column).isin(top), F.lit(False))).cast("int").alias(f"{column}_other"))
    table = category_frequencies(df, column) if how == "frequency" else target_means(df, column, target)
    value = "frequency" if how == "frequency" else "target_mean"
    table = table.select(F.col("category").alias("_c"), F.col(value).alias(f"{column}_{value}"))
    return df.join(table, F.col(column) == F.col("_c"), "left").drop("_c")


def folds(df: DataFrame, target: str, k: int, order: list[str], regression: bool, strata: int = 10) -> DataFrame:
    """df with fold 0..k-1, stratified by class, or by tenths of a numeric target."""
    if regression:
        cuts = F.percentile_approx(target, [i / strata for i in range(1, strata)], 10_000)
        bounds = df.agg(cuts.alias("_cuts"))
        df = df.crossJoin(F.broadcast(bounds)).withColumn("_stratum", F.size(F.filter("_cuts", lambda c: c < F.col(target)))).drop("_cuts")  # one row
    else:
        df = df.withColumn("_stratum", F.col(target))
    w = Window.partitionBy("_stratum").orderBy(*order)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int")).drop("_stratum")


def stratified_sample(df: DataFrame, stratum: str, fraction: float, key: str, seed: int = 1) -> DataFrame:
    """About `fraction` of each stratum, the same rows every time: those with the smallest hashes of the key."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(h < fraction)


def bounded_sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes of the key: a bounded, repeatable reservoir."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def mic(x: np.ndarray, y: np.ndarray, exponent: float = 0.6, clumps: int = 15) -> float:
    """Maximal information coefficient over equal-frequency grids of at most n**exponent cells."""
    n = len(x)
    if n < 4 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    budget = max(n**exponent, 4)
    rank = lambda v: np.searchsorted(np.sort(v), v, "left") / n
    rx, ry, best = rank(x), rank(y), 0.0
    for a in range(2, min(int(budget // 2), clumps) + 1):
        cx = np.minimum((rx * a).astype(int), a - 1)
        for b in range(2, min(int(budget // a), clumps) + 1):
            cy = np.minimum((ry * b).astype(int), b - 1)
            joint = np.bincount(cx * b + cy, minlength=a * b).reshape(a, b) / n
            px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
            m = joint > 0
            info = float(np.sum(joint[m] * np.log(joint[m] / (px @ py)[m])))
            best = max(best, info / np.log(min((px > 0).sum(), (py > 0).sum()) + 1e-12) if min((px > 0).sum(), (py > 0).sum()) > 1 else 0.0)
    return min(1.0, best)


def feature_relevance(df: DataFrame, columns: list[str], target: str, key: str, rows: int = 5000) -> DataFrame:
    """(feature, mic) of each column with the target, from a bounded sample, features dealt over tasks."""
    sample = bounded_sample(df.where(F.col(target).isNotNull()), rows, key)
    long = sample.select(
        F.col(target).cast("double").alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f"),
    ).select("f.feature", "f.x", "y").where("x is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "mic": [mic(pdf["x"].to_numpy(), pdf["y"].to_numpy())]})

    return long.groupBy("feature").applyInPandas(run, "feature string, mic double")


def best_columns(table: np.ndarray, most: int) -> np.ndarray:
    """For 1 to `most` columns, the largest sum over columns of sum(c log c) - C log C, c a column's counts by row of the table and C their sum.

    Columns are runs of the table's fine columns; the best cut of the first j of them in l runs comes from those in l - 1.
    """
    upto = np.concatenate([np.zeros((1, table.shape[0])), np.cumsum(table.T, axis=0)])
    inside = upto[None, :, :] - upto[:, None, :]  # counts between any two cuts
    log = lambda c: np.where(c > 0, c * np.log(np.maximum(c, 1)), 0.0)
    value = np.where(np.triu(np.ones(inside.shape[:2], bool), 1), log(inside).sum(2) - log(inside.sum(2)), -np.inf)
    best, out = value[0], [value[0, -1]]
    for _ in range(1, most):
        best = (best[:, None] + value).max(0)
        out.append(max(best[-1], out[-1]))
    return np.array(out)


def mic_of_table(table: np.ndarray, exponent: float = 0.6, clumps: int = 15) -> float:
    """Maximal information coefficient of a table of counts over fine bins of x and y, from the grids of at most n**exponent cells.

    Each side in turn is cut evenly, and the other where the information is largest.
    """
    n = table.sum()
    if n < 4 or (table.sum(0) > 0).sum() < 2 or (table.sum(1) > 0).sum() < 2:
        return 0.0
    budget, best = max(n**exponent, 4), 0.0
    for t in (table[table.sum(1) > 0][:, table.sum(0) > 0], table.T[table.sum(0) > 0][:, table.sum(1) > 0]):
        share = np.cumsum(t.sum(1)) - t.sum(1) / 2
        for rows in range(2, min(int(budget // 2), clumps, len(t)) + 1):
            label = np.minimum((share * rows / n).astype(int), rows - 1)
            merged = np.zeros((rows, t.shape[1]))
            np.add.at(merged, label, t)
            p = merged.sum(1)[merged.sum(1) > 0] / n
            if len(p) < 2:
                continue
            gains = best_columns(merged, min(int(budget // rows), clumps, t.shape[1]))
            for columns, gain in enumerate(gains, 1):
                if columns > 1:
                    best = max(best, (gain / n - (p * np.log(p)).sum()) / np.log(min(columns, len(p))))
    return float(min(1.0, max(best, 0.0)))


def relevance(df: DataFrame, columns: list[str], target: str, bins: int = 64) -> DataFrame:
    """(feature, mic, rows) of each column with the target, over all rows that hold both.

    Every column is cut in fine bins of about equal size; rows meet as counts by pair of bins, which is all that grids are looked
    for in.  NaN counts as missing.
    """
    typed = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate([target, *columns])]).where("c0 is not null")
    cuts = typed.approxQuantile([f"c{i}" for i in range(len(columns) + 1)], [k / bins for k in range(1, bins)], 1 / (8 * bins))
    place = lambda i: F.size(F.filter(F.array(*[F.lit(float(v)) for v in sorted(set(cuts[i]))]).cast("array<double>"), lambda e: e < F.col(f"c{i}")))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(f"c{i}").isNotNull(), place(i)).alias("x")) for i, c in enumerate(columns, 1)])
    counts = typed.select(place(0).alias("y"), F.explode(pairs).alias("f")).select("y", "f.feature", "f.x").where("x is not null").groupBy("feature", "x", "y").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((pdf["x"].max() + 1, pdf["y"].max() + 1))
        table[pdf["x"], pdf["y"]] = pdf["count"]
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "mic": [mic_of_table(table)], "rows": [int(pdf["count"].sum())]})

    return counts.groupBy("feature").applyInPandas(run, "feature string, mic double, rows long")


def quadratic_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, constant, linear, square): least squares of y on 1, x and x squared, from moments that add up as rows come.

    x is taken about its mean over all rows and in units of its spread, and the result brought back.  With fewer than three
    distinct x in a key square is null, with fewer than two linear too.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    about = both.agg(F.avg(x).alias("_m"), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    u = (F.col(x) - F.col("_m")) / F.col("_s")
    rows = both.join(F.broadcast(about)).withColumn("_u", u).withColumn("_q", u * u)  # one row on the right
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("ay"), F.avg("_u").alias("au"), F.avg("_q").alias("aq"), F.var_pop("_u").alias("uu"), F.var_pop("_q").alias("qq"),
        F.covar_pop("_u", "_q").alias("uq"), F.covar_pop(y, "_u").alias("yu"), F.covar_pop(y, "_q").alias("yq"), F.first("_m").alias("m"), F.first("_s").alias("s"),
    )
    c = F.col
    left = c("qq") - c("uq") ** 2 / F.nullif(c("uu"), F.lit(0.0))
    square = F.when(left > 1e-10 * c("qq"), (c("yq") - c("yu") * c("uq") / c("uu")) / left)
    linear = F.when(c("uu") > 0, (c("yu") - F.coalesce(c("_2"), F.lit(0.0)) * c("uq")) / c("uu"))
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    fit = g.withColumn("_2", square).withColumn("_1", linear).withColumn("_0", c("ay") - zero("_1") * c("au") - zero("_2") * c("aq"))
    return fit.select(
        *keys, "n", (c("_0") - zero("_1") * c("m") / c("s") + zero("_2") * (c("m") / c("s")) ** 2).alias("constant"),
        (c("_1") / c("s") - 2 * zero("_2") * c("m") / c("s") ** 2).alias("linear"), (c("_2") / c("s") ** 2).alias("square"),
    )


def choose_features(relevance: pd.DataFrame, redundancy: dict[tuple[str, str], float], most: int) -> list[str]:
    """Greedy choice by relevance less mean redundancy with those chosen before."""
    left, out = dict(zip(relevance["feature"], relevance["mic"])), []
    while left and len(out) < most:
        gain = {f: r - (np.mean([redundancy.get((f, g), redundancy.get((g, f), 0.0)) for g in out]) if out else 0.0) for f, r in left.items()}
        best = max(gain, key=lambda f: (gain[f], f))
        if gain[best] <= 0:
            break
        out.append(best)
        del left[best]
    return out


def sketches(df: DataFrame, by: str, value: str, item: str) -> DataFrame:
    """(by, distinct, quantiles): mergeable approximations of a group's distinct items and quartiles."""
    return df.groupBy(by).agg(
        F.approx_count_distinct(item, 0.02).alias("distinct"), F.percentile_approx(value, [0.25, 0.5, 0.75], 1000).alias("quartiles")
    )


def item_counts(df: DataFrame, item: str, error: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    """One row with a count-min sketch of the items, for other tables to look counts up in."""
    return df.agg(F.count_min_sketch(F.col(item), F.lit(error), F.lit(confidence), F.lit(seed)).alias("sketch"))


def ks_distance(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the Kolmogorov-Smirnov distance of the values of group 0 and group 1 (a column of 0 and 1)."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    t = g.agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    upto = running_totals_by_value(g.withColumn("_all", F.lit(0)), ["_all"], value, ["a", "b"])
    return upto.crossJoin(F.broadcast(t)).agg(  # one row
        F.max(F.abs(F.col("a_upto") / F.col("_ta") - F.col("b_upto") / F.col("_tb"))).alias("distance")
    )


def preprocessed(df: DataFrame, processors: list[dict]) -> DataFrame:
    """df with the columns of a caller's own encodings, each {"kind", "field", ...}; nulls encode as the kind's default.

    n_gram: {"length", "start", "n_grams"} letters of a text from start on, one column a position.  one_hot: {"values": {value:
    column}}.  frequency and target_mean: {"table": {value: number}, "default", "column"}.  multi: {"processors"}, each
    reading what the ones before wrote.
    """
    for p in processors:
        kind, field = p["kind"], p.get("field")
        if kind == "multi":
            df = preprocessed(df, p["processors"])
        elif kind == "n_gram":
            part = F.substring(F.coalesce(F.col(field), F.lit("")), p.get("start", 0) + 1, p["length"])
            for n in p["n_grams"]:
                for i in range(p["length"] - n + 1):
                    df = df.withColumn(f"{field}.{n}{i}", F.when(F.length(part) >= i + n, F.substring(part, i + 1, n)).otherwise(F.lit("")))
        elif kind == "one_hot":
            df = df.withColumns({c: F.coalesce(F.col(field).cast("string") == v, F.lit(False)).cast("int") for v, c in p["values"].items()})
        elif kind in ("frequency", "target_mean"):
            table = F.create_map(*[F.lit(x) for kv in p["table"].items() for x in (kv[0], float(kv[1]))])
            df = df.withColumn(p["column"], F.coalesce(F.try_element_at(table, F.coalesce(F.col(field).cast("string"), F.lit(""))), F.lit(float(p.get("default", 0.0)))))
        else:
            raise ValueError(f"unknown processor: {kind!r}")
    return df


def shrunk_covariance(moments: np.ndarray, n: int) -> np.ndarray:
    """A covariance matrix drawn towards a multiple of the identity, more so the fewer rows it is from."""
    d = len(moments)
    scale = np.trace(moments) / d
    spread = np.sum((moments - scale * np.eye(d)) ** 2)
    pull = min(1.0, (np.trace(moments @ moments) + np.trace(moments) ** 2) / max((n + 2) * spread, 1e-300))
    return (1 - pull) * moments + pull * scale * np.eye(d)


def covariance(df: DataFrame, columns: list[str], shrink: bool = True) -> np.ndarray:
    """The columns' covariance matrix from one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"c{i}_{j}"] or 0.0
    return shrunk_covariance(m, row["n"]) if shrink else m
