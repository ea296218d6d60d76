"""Probability models of bucket values: conjugate priors, their selection, and scoring per key.

Each model learns a bucket first and gives its probability afterwards, as a detector does.  Keys are
independent, so a key's buckets go through numpy in time order inside applyInPandas; the rows a key has are
buckets, not events.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.special import beta_cdf, f_right_tail, gamma_upper, t_two_sided
from driftwell.operators.skew import join_counted
from driftwell.sources.tables import dropped, written

LEAST = 2.2250738585072014e-308


class NormalModel:
    """Normal values of unknown mean and precision; predictive Student t."""

    name = "normal"

    def __init__(self):
        self.n, self.mean, self.m2 = 0.0, 0.0, 0.0

    def age(self, by: float) -> None:
        self.n *= by
        self.m2 *= by

    def add(self, x: float, weight: float = 1.0) -> None:
        self.n += weight
        d = x - self.mean
        self.mean += d * weight / self.n
        self.m2 += weight * d * (x - self.mean)

    def scale(self) -> float:
        return math.sqrt(max(self.m2 / max(self.n, 1.0), 1e-12 * max(1.0, self.mean**2)) * (1 + 1 / max(self.n, 1.0)))

    def log_density(self, x: float) -> float:
        if self.n < 2:
            return -math.log(1e6)
        v, s = self.n, self.scale()
        z = (x - self.mean) / s
        return math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(s) - (v + 1) / 2 * math.log1p(z * z / v)

    def tails(self, x: float) -> tuple[float, float]:
        """(P(X <= x), P(X >= x))."""
        if self.n < 2:
            return 0.5, 0.5
        z = (x - self.mean) / self.scale()
        half = t_two_sided(z, self.n) / 2
        return (half, 1 - half) if z < 0 else (1 - half, half)


class LogNormalModel(NormalModel):
    """As NormalModel for log(1 + x - offset); for values from -offset up."""

    name = "log_normal"

    def add(self, x: float, weight: float = 1.0) -> None:
        super().add(math.log1p(max(x, 0.0)), weight)

    def log_density(self, x: float) -> float:
        y = max(x, 0.0)
        return super().log_density(math.log1p(y)) - math.log1p(y)

    def tails(self, x: float) -> tuple[float, float]:
        return super().tails(math.log1p(max(x, 0.0)))


class GammaModel:
    """Gamma values: shape from the mean log, rate from the mean."""

    name = "gamma"

    def __init__(self):
        self.n = self.total = self.logs = 0.0

    def age(self, by: float) -> None:
        self.n, self.total, self.logs = self.n * by, self.total * by, self.logs * by

    def add(self, x: float, weight: float = 1.0) -> None:
        y = max(x, 0.0) + 0.1
        self.n, self.total, self.logs = self.n + weight, self.total + weight * y, self.logs + weight * math.log(y)

    def shape_rate(self) -> tuple[float, float]:
        mean = self.total / self.n
        s = max(math.log(mean) - self.logs / self.n, 1e-6)
        k = min((3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s), 1e5)
        return k, k / mean

    def log_density(self, x: float) -> float:
        if self.n < 2:
            return -math.log(1e6)
        k, r = self.shape_rate()
        y = max(x, 0.0) + 0.1
        return k * math.log(r) - math.lgamma(k) + (k - 1) * math.log(y) - r * y

    def tails(self, x: float) -> tuple[float, float]:
        if self.n < 2:
            return 0.5, 0.5
        k, r = self.shape_rate()
        upper = gamma_upper(k, r * (max(x, 0.0) + 0.1))
        return 1 - upper, upper


class PoissonModel:
    """Counts with a gamma prior on their rate; predictive negative binomial."""

    name = "poisson"

    def __init__(self):
        self.shape, self.rate = 0.1, 0.1

    def age(self, by: float) -> None:
        self.shape, self.rate = 0.1 + (self.shape - 0.1) * by, 0.1 + (self.rate - 0.1) * by

    def add(self, x: float, weight: float = 1.0) -> None:
        self.shape, self.rate = self.shape + weight * max(x, 0.0), self.rate + weight

    def log_density(self, x: float) -> float:
        k, a, b = max(round(x), 0), self.shape, self.rate
        return math.lgamma(a + k) - math.lgamma(a) - math.lgamma(k + 1) + a * math.log(b / (b + 1)) - k * math.log(b + 1)

    def tails(self, x: float) -> tuple[float, float]:
        k, p = max(round(x), 0), self.rate / (self.rate + 1)
        return beta_cdf(p, self.shape, k + 1), beta_cdf(1 - p, k, self.shape) if k else 1.0


class OneOfN:
    """The models of a value weighted by how well they foretold it so far."""

    def __init__(self, counts: bool):
        self.models = [NormalModel(), LogNormalModel(), GammaModel()] + ([PoissonModel()] if counts else [])
        self.logs = np.zeros(len(self.models))

    def age(self, by: float) -> None:
        self.logs *= by
        for m in self.models:
            m.age(by)

    def add(self, x: float) -> None:
        self.logs += [max(m.log_density(x), -50.0) for m in self.models]
        for m in self.models:
            m.add(x)

    def weights(self) -> np.ndarray:
        w = np.exp(self.logs - self.logs.max())
        return w / w.sum()

    def tails(self, x: float) -> tuple[float, float]:
        w = self.weights()
        t = np.array([m.tails(x) for m in self.models])
        return float(w @ t[:, 0]), float(w @ t[:, 1])

    def best(self) -> str:
        return self.models[int(np.argmax(self.logs))].name


class Modes:
    """Several modes, each a normal model: a value far from all of them may found its own."""

    def __init__(self, most: int = 6, apart: float = 6.0):
        self.most, self.apart, self.modes = most, apart, []

    def settled(self) -> list[NormalModel]:
        """Modes that more than a stray value or two made."""
        return [m for m in self.modes if m.n > 2.5]

    def nearest(self, x: float) -> NormalModel | None:
        return min(self.modes, key=lambda m: abs(x - m.mean), default=None)

    def age(self, by: float) -> None:
        for m in self.modes:
            m.age(by)

    def add(self, x: float) -> None:
        m = self.nearest(x)
        far = m is None or abs(x - m.mean) > self.apart * max(m.scale() if m.n >= 3 else 0.1 * abs(m.mean) + 1.0, 1e-9)
        if far and len(self.modes) < self.most:
            m = NormalModel()
            self.modes.append(m)
        m.add(x)

    def tails(self, x: float) -> tuple[float, float]:
        known = self.settled()
        if not known:
            return 0.5, 0.5
        t = np.array([m.tails(x) for m in known])
        w = np.array([m.n for m in known]) / sum(m.n for m in known)
        return float(w @ t[:, 0]), float(w @ t[:, 1])


def probability(tails: tuple[float, float], tail: str) -> float:
    low, high = tails
    p = low if tail == "low" else high if tail == "high" else min(1.0, 2 * min(low, high))
    return min(1.0, max(p, LEAST))


def series_scores(x: np.ndarray, counts: bool, tail: str, rate: float) -> tuple[np.ndarray, np.ndarray, str]:
    """(typical, probability) of each value of a series, learned in order, and the best model's name."""
    model, modes = OneOfN(counts), Modes()
    typical, p = np.empty(len(x)), np.empty(len(x))
    seen = NormalModel()
    for i, v in enumerate(x):
        for m in (model, modes, seen):
            m.age(math.exp(-rate))
            m.add(v)
        typical[i] = seen.mean
        p[i] = max(probability(model.tails(v), tail), probability(modes.tails(v), tail)) if len(modes.settled()) > 1 else probability(model.tails(v), tail)
    return typical, p, model.best() if len(x) else "none"


def model_scores(df: DataFrame, keys: list[str], bucket: str, value: str, counts: bool = True, tail: str = "two_sided", rate: float = 0.0005) -> DataFrame:
    """(keys, bucket, actual, typical, probability, model): every bucket value against its key's model."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, bucket]) + ", actual double, typical double, probability double, model string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["actual"]).sort_values(bucket, kind="stable")
        typical, p, name = series_scores(pdf["actual"].to_numpy(float), counts, tail, rate)
        return pdf[[*keys, bucket, "actual"]].assign(typical=typical, probability=p, model=name)

    return df.select(*keys, bucket, F.col(value).cast("double").alias("actual")).groupBy(*keys).applyInPandas(run, schema)


def multinomial_probability(counts: np.ndarray, category: int, concentration: float = 1.0) -> float:
    """Chance of a category at most as likely as this one under smoothed counts, ties included."""
    c = np.asarray(counts, float) + concentration / len(counts)
    return float(c[c <= c[category] + 1e-12].sum() / c.sum())


def pair_probabilities(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The rows of df that hold both numbers, with probability: the chance of a pair at most as likely under its key's normal model of two variables.

    Mean and precision are unknown, so the predictive law is Student's t of n - 2 degrees; in two dimensions its tail has a closed form.
    The moments are one aggregation a key.  Fewer than three pairs, or pairs on one line, tell nothing: probability 1.  Null keys are a key.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    n = F.count(F.lit(1))
    moments = both.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        n.alias("_n"), F.avg(a).alias("_x"), F.avg(b).alias("_y"), (n * F.var_pop(a)).alias("_xx"), (n * F.covar_pop(a, b)).alias("_xy"), (n * F.var_pop(b)).alias("_yy")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    dx, dy, det = a - F.col("_x"), b - F.col("_y"), F.col("_xx") * F.col("_yy") - F.col("_xy") ** 2
    far = (dx * dx * F.col("_yy") - 2 * dx * dy * F.col("_xy") + dy * dy * F.col("_xx")) / F.nullif(det, F.lit(0.0)) * F.col("_n") / (F.col("_n") + 1)
    known = (F.col("_n") >= 3) & (det > 1e-12 * F.col("_xx") * F.col("_yy"))
    p = F.when(known, F.greatest(F.exp(-(F.col("_n") - 2) / 2 * F.log1p(far)), F.lit(LEAST))).otherwise(F.lit(1.0))
    return both.join(moments, on).select(*df.columns, p.alias("probability"))


def constant_scores(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows of df with a value, with constant (the key's first value in order) and probability: 1 of the constant, all but none of others."""
    known = df.where(F.col(value).isNotNull())
    first = known.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min_by(value, F.struct(*order, value)).alias("constant"))
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    p = F.when(F.col(value) == F.col("constant"), 1.0).otherwise(LEAST)
    return known.join(first, on).select(*df.columns, "constant", p.alias("probability"))


# --- populations: one model of an attribute over all its members -------------------------------------------

#: The models of a population's values and, by each, the number that its law is of.
POPULATION = ("normal", "log_normal", "gamma")


def population_states(pdf: pd.DataFrame, rate: float) -> pd.DataFrame:
    """Of one attribute's buckets in order: each model's parameters before and after the bucket, and the constant of its density."""
    pdf = pdf.sort_values("t")
    out = {f"{when}_{c}": [] for when in ("before", "after") for c in ("n", "n_mean", "n_scale", "l_mean", "l_scale", "shape", "rate", "n_const", "g_const")}
    n, total, logs = 0.0, 0.0, 0.0
    moments = {"n": [0.0, 0.0], "l": [0.0, 0.0]}  # mean and sum of squares about it

    def note(when: str) -> None:
        own = {"n": n}
        for m, (mean, m2) in moments.items():
            own[f"{m}_mean"] = mean
            own[f"{m}_scale"] = math.sqrt(max(m2 / max(n, 1.0), 1e-12 * max(1.0, mean**2)) * (1 + 1 / max(n, 1.0)))
        known = n >= 2
        k = r = 1.0
        if known:
            s = max(math.log(total / n) - logs / n, 1e-6)
            k = min((3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s), 1e5)
            r = k / (total / n)
        own |= {"shape": k, "rate": r, "g_const": k * math.log(r) - math.lgamma(k), "n_const": math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi) if known else 0.0}
        for c, v in own.items():
            out[f"{when}_{c}"].append(v)

    for row in pdf.itertuples():
        keep = math.exp(-rate)
        n, total, logs = n * keep, total * keep, logs * keep
        for m in moments.values():
            m[1] *= keep
        note("before")
        for m, mean, square in (("n", row.mean, row.square), ("l", row.log_mean, row.log_square)):
            d = mean - moments[m][0]
            moments[m] = [moments[m][0] + d * row.n / (n + row.n), moments[m][1] + square + d * d * n * row.n / (n + row.n)]
        n, total, logs = n + row.n, total + row.total, logs + row.logs
        note("after")
    return pdf.assign(**out)


def population_scores(df: DataFrame, keys: list[str], bucket: str, value: str, tail: str = "two_sided", rate: float = 0.0005) -> DataFrame:
    """(df's columns, typical, probability, model): each member's value in a bucket against the model of all members of its attribute.

    A bucket's values are learned together and scored afterwards.  What a law keeps of them are sums, which meet before any
    shuffle; a key's buckets then go through in order, and rows look the laws up again, a common (key, bucket) from many
    tasks.  So no group holds an attribute's members.  Rows without a value take no part; keys must not be null.
    """
    y = F.col(value).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y) & F.col(bucket).isNotNull()).withColumn("_x", y)
    log, up = F.log1p(F.greatest("_x", F.lit(0.0))), F.greatest("_x", F.lit(0.0)) + 0.1
    on = [*keys, bucket]
    sums = rows.groupBy(*on).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_x").alias("mean"), (F.count(F.lit(1)) * F.var_pop("_x")).alias("square"),
        F.avg(log).alias("log_mean"), (F.count(F.lit(1)) * F.var_pop(log)).alias("log_square"), F.sum(up).alias("total"), F.sum(F.log(up)).alias("logs"),
    ).withColumn("t", F.col(bucket))
    kinds = dict(sums.dtypes)
    names = [f"{when}_{c}" for when in ("before", "after") for c in ("n", "n_mean", "n_scale", "l_mean", "l_scale", "shape", "rate", "n_const", "g_const")]
    first = ", ".join(f"`{c}` {kinds[c]}" for c in sums.columns)
    states = written(sums.groupBy(*keys).applyInPandas(lambda pdf: population_states(pdf, rate), f"{first}, " + ", ".join(f"{c} double" for c in names)))
    before = join_counted(rows.select(*on, "_x"), states.select(*on, "n", *names[:9]), on, "n", ["_x"])
    n = F.col("before_n")
    student = lambda v, m: F.col("before_n_const") - F.log(F.col(f"before_{m}_scale")) - (n + 1) / 2 * F.log1p(((v - F.col(f"before_{m}_mean")) / F.col(f"before_{m}_scale")) ** 2 / n)
    known = lambda d: F.when(n >= 2, d).otherwise(-math.log(1e6))
    densities = [known(student(F.col("_x"), "n")), known(student(log, "l")) - log, known(F.col("before_g_const") + (F.col("before_shape") - 1) * F.log(up) - F.col("before_rate") * up)]
    bounded = [F.greatest(d, F.lit(-50.0)) for d in densities]
    told = before.groupBy(*on).agg(*[F.sum(d).alias(f"_d{i}") for i, d in enumerate(bounded)])

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(bucket)
        logs, out = np.zeros(len(POPULATION)), []
        for d in pdf[[f"_d{i}" for i in range(len(POPULATION))]].to_numpy():
            logs = logs * math.exp(-rate) + d
            w = np.exp(logs - logs.max())
            out.append(w / w.sum())
        w = np.array(out).reshape(-1, len(POPULATION))
        return pdf[on].assign(**{f"w{i}": w[:, i] for i in range(len(POPULATION))}, model=[POPULATION[i] for i in w.argmax(1)] if len(w) else [])

    on_schema = ", ".join(f"`{c}` {kinds[c]}" for c in on)
    weights = told.groupBy(*keys).applyInPandas(weigh, f"{on_schema}, " + ", ".join(f"w{i} double" for i in range(len(POPULATION))) + ", model string")
    laws = written(states.select(*on, "n", *names[9:16]).join(weights, on))
    dropped(states)

    def tails(*columns: pd.Series) -> pd.Series:
        out = []
        for v, m, a, b, c, d, k, r, *w in zip(*columns):
            low = high = 0.0
            if m < 2:
                low = high = 0.5
            else:
                for z, share in (((v - a) / b, w[0]), ((math.log1p(max(v, 0.0)) - c) / d, w[1])):
                    half = t_two_sided(z, m) / 2
                    low, high = low + share * (half if z < 0 else 1 - half), high + share * (1 - half if z < 0 else half)
                upper = gamma_upper(k, r * (max(v, 0.0) + 0.1))
                low, high = low + w[2] * (1 - upper), high + w[2] * upper
            out.append(probability((low, high), tail))
        return pd.Series(out, dtype=float)

    p = F.pandas_udf(tails, "double")("_x", "after_n", "after_n_mean", "after_n_scale", "after_l_mean", "after_l_scale", "after_shape", "after_rate", "w0", "w1", "w2")
    both = join_counted(rows, laws.withColumnRenamed("n", "_members"), on, "_members", ["_x"])
    return both.select(*df.columns, F.col("after_n_mean").alias("typical"), p.alias("probability"), "model")


def vector_probabilities(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of df that hold all numbers, with probability: the chance of a vector at most as likely under its key's normal model of d variables.

    Mean and precision are unknown, so the predictive law is Student's of n - d degrees.  A key's moments are one aggregation that
    merges before the shuffle, factored once a key; rows look the result up.  Fewer than d + 1 vectors, or vectors in a
    plane, tell nothing: probability 1.  A null key joins no model and has probability 1 too.
    """
    d, values = len(columns), [F.col(c).cast("double") for c in columns]
    whole = reduce(operator.and_, [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for v in values])
    rows = df.where(whole)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(values)], *[F.covar_pop(values[i], values[j]).alias(f"_c{i}_{j}") for i, j in pairs]
    )

    def factor(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                c = np.zeros((d, d))
                for i, j in pairs:
                    c[i, j] = c[j, i] = getattr(row, f"c{i}_{j}")
                scale = np.sqrt(np.diag(c))
                ok = row.n > d and (scale > 0).all() and np.linalg.eigvalsh(c / np.outer(scale, scale))[0] > 1e-12
                out.append((np.linalg.inv(np.linalg.cholesky(c)) / math.sqrt(row.n)).ravel().tolist() if ok else None)
            yield pdf[[f"k{i}" for i in range(len(keys))] + ["n"]].assign(mean=[list(m) for m in pdf[[f"m{i}" for i in range(d)]].to_numpy()], factor=out)

    kinds = dict(sums.dtypes)
    plain = sums.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(c[1:]) for c in sums.columns if c not in keys])
    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", n long, mean array<double>, factor array<double>"
    table = written(plain.mapInPandas(factor, schema)).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("factor").alias("_factor"))

    def chance(x: pd.Series, n: pd.Series, mean: pd.Series, factor: pd.Series) -> pd.Series:
        out = []
        for v, k, m, f in zip(x, n, mean, factor):
            if f is None or k <= d:
                out.append(1.0)
                continue
            z = np.array(f, float).reshape(d, d) @ (np.array(v, float) - np.array(m, float))
            out.append(max(f_right_tail(float(z @ z) * k / (k + 1) * (k - d) / d, d, k - d), LEAST))
        return pd.Series(out, dtype=float)

    p = F.pandas_udf(chance, "double")(F.array(*values), "_n", "_mean", "_factor")
    known = join_counted(rows, table, keys, "_n", columns).select(*df.columns, p.alias("probability"))
    null_key = reduce(operator.or_, [F.col(k).isNull() for k in keys], F.lit(False))
    return known.unionByName(rows.where(null_key).withColumn("probability", F.lit(1.0)))
