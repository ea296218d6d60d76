"""Embedding whitening: a compensated covariance over Spark's tasks, and a divide-and-conquer eigen-solver for its matrix.

Vectors become whole numbers x = floor(scale * c) + offset, so that count and sums per dimension are exact and every
task centres by the exact mean S / n.  Each task adds up outer products of its centred vectors in double-double: products and
sums by error-free transformations, whose high and low parts are kept apart and merged across tasks, one row of
the matrix at a time.  The driver gets what is as large as the dimension: n, S and the matrix.  It is brought to
tridiagonal form by Householder reflections and solved by halving (Cuppen's method with Gu and Eisenstat's vectors).

Rows: a null vector, one with a null or non-finite entry and one of another length than most (of equally common
lengths the longest counts) take no part; null and repeated ids are kept row by row; extra columns are ignored.  Entries
beyond 2**62 in size after scaling count as 2**62.  Components whose eigenvalue is zero to rounding (d * 2**-52 of the largest)
don't exist, so equal vectors, a single one or an empty table give no rows.  A deviation of over 38 digits is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 256  # vectors whose products a task holds at a time
SPREAD = 64  # groups that a row of the matrix is merged in first


# --- error-free transformations: each gives a sum or product rounded, and what the rounding left ---


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    t = 134217729.0 * a  # 2**27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a, b, parts_a, parts_b):
    p = a * b
    (ah, al), (bh, bl) = parts_a, parts_b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x, y):
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    return two_sum(s, e + (x[1] + y[1]))


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum over the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        h, low_ = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(high) % 2:
            h, low_ = np.concatenate([h, high[-1:]]), np.concatenate([low_, low[-1:]])
        high, low = h, low_
    return high[0], low[0]


class Products:
    """Sums of products of every two columns, double-double, upper triangle row by row."""

    def __init__(self, dimensions: int):
        self.rows = [(np.zeros(dimensions - i), np.zeros(dimensions - i)) for i in range(dimensions)]

    def take(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add the outer products of the vectors high + low."""
        for at in range(0, len(high), ROWS):
            h, e = high[at : at + ROWS], low[at : at + ROWS]
            hh, hl = split(h)
            for i, so_far in enumerate(self.rows):
                a = h[:, i : i + 1]
                p, q = two_product(a, h[:, i:], (hh[:, i : i + 1], hl[:, i : i + 1]), (hh[:, i:], hl[:, i:]))
                q += a * e[:, i:] + e[:, i : i + 1] * h[:, i:]
                self.rows[i] = add(so_far, total(*two_sum(p, q)))


def summed_products(df: DataFrame, dimensions: int, columns) -> tuple[np.ndarray, np.ndarray]:
    """The high and low parts of the matrix of summed products of columns(batch), a pair (high, low) of rows of numbers."""
    schema, arrow = "i int, part int, high binary, low binary", pa.schema([("i", pa.int32()), ("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        sums, met = Products(dimensions), False
        for batch in batches:
            if batch.num_rows:
                sums.take(*columns(batch))
                met = True
        if met:
            part = TaskContext.get().partitionId() % SPREAD
            for i, (h, low) in enumerate(sums.rows):
                yield pa.RecordBatch.from_pylist([{"i": i, "part": part, "high": h.tobytes(), "low": low.tobytes()}], arrow)

    def merge(table: pa.Table) -> pa.Table:
        h, low = total(*(np.stack([np.frombuffer(b, float) for b in table.column(c).to_pylist()]) for c in ("high", "low")))
        first = table.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([first | {"high": h.tobytes(), "low": low.tobytes()}], arrow)

    rows = df.mapInArrow(run, schema)
    rows = rows.groupBy("i", "part").applyInArrow(merge, schema).groupBy("i").applyInArrow(merge, schema)
    high, low = np.zeros((dimensions, dimensions)), np.zeros((dimensions, dimensions))
    for r in rows.collect():  # one row a dimension
        for m, b in ((high, r["high"]), (low, r["low"])):
            m[r["i"], r["i"] :] = m[r["i"] :, r["i"]] = np.frombuffer(bytes(b), float)
    return high, low


# --- eigenvectors of a symmetric matrix ---


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): q' a q is tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        w = block @ v
        w -= (v @ w) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z', rho > 0."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z, turn = d[order], z[order].copy(), np.eye(n)[:, order]
    tiny = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * (z @ z))
    live: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) * np.linalg.norm(z) <= tiny:
            z[i] = 0.0
        elif live and d[i] - d[live[-1]] <= tiny:
            # two equal poles: a rotation leaves the whole weight with the later one
            k = live.pop()
            r = np.hypot(z[k], z[i])
            c, s = z[i] / r, z[k] / r
            z[k], z[i] = 0.0, r
            turn[:, [k, i]] = turn[:, [k, i]] @ np.array([[c, s], [-s, c]])
            live.append(i)
        else:
            live.append(i)
    values, vectors = d.copy(), np.eye(n)
    if live:
        p, w = d[live], z[live]
        gaps = np.append(np.diff(p), rho * (w @ w))
        # each root lies between its pole and the next: measured from the nearer one, by bisection
        f = lambda base, mu: 1 + rho * (w * w / ((p - base[:, None]) - mu[:, None])).sum(1)
        with np.errstate(divide="ignore", over="ignore"):
            left = f(p, gaps / 2) >= 0
            left[-1] = True
            base = np.where(left, p, p + gaps)
            base[:-1] = np.where(left[:-1], p[:-1], p[1:])
            lo, hi = np.where(left, 0.0, -gaps / 2), np.where(left, gaps / 2, 0.0)
            hi[-1] = gaps[-1]
            for _ in range(120):
                mid = (lo + hi) / 2
                above = f(base, mid) >= 0
                lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
        mu = (lo + hi) / 2
        away = (base[:, None] - p) + mu[:, None]  # root j less pole i
        # the weights for which these roots are exact: vectors from them are orthogonal however close the roots
        with np.errstate(divide="ignore"):
            between = p[:, None] - p
            np.fill_diagonal(between, 1.0)
            logs = np.log(np.abs(away)).sum(0) - np.log(np.abs(between)).sum(0)
        w = np.copysign(np.exp(logs / 2), w)
        away[away == 0] = np.finfo(float).tiny
        v = (w / -away).T
        vectors[np.ix_(live, live)] = v / np.linalg.norm(v, axis=0)
        values[live] = base + mu
    return values, turn @ vectors


def halves(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a tridiagonal matrix: two halves and one rank-one change that joins them."""
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    m, rho = n // 2, abs(e[n // 2 - 1])
    top, bottom = d[:m].copy(), d[m:].copy()
    top[-1] -= rho
    bottom[0] -= rho
    (v1, q1), (v2, q2) = halves(top, e[: m - 1]), halves(bottom, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    values = np.concatenate([v1, v2])
    if rho == 0:
        return values, q
    z = np.concatenate([q1[-1], np.copysign(1.0, e[m - 1]) * q2[0]])
    values, vectors = rank_one(values, z, rho)
    return values, q @ vectors


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of a symmetric matrix; of either sign the one whose largest entry is positive."""
    size = np.abs(a).max(initial=0.0)
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    values, vectors = halves(d, e)
    vectors = q @ vectors
    vectors = vectors @ (1.5 * np.eye(len(a)) - 0.5 * vectors.T @ vectors)  # one Newton step towards orthonormal columns
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(len(a))]
    return values[order] * size, vectors * np.where(largest < 0, -1.0, 1.0)


# --- the operator ---


@dataclass
class Whitening:
    """What was fitted: n vectors with sums S, scale and offset; eigenvalues and vectors of their covariance."""

    n: int
    sums: list[int]
    scale: float
    offset: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def project(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length."""
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", whole))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def whole_numbers(batch: pa.RecordBatch, d: int, scale: float, offset: int) -> np.ndarray:
    """The vectors as rows of whole numbers."""
    c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(c * scale, -(2.0**62), 2.0**62)).astype(np.int64) + offset


def mean_parts(n: int, sums: list[int]) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """S / n as whole part, remainder of n, and the remainder's share of n in double-double."""
    whole, rest = zip(*(divmod(s, n) for s in sums))
    high = [float(Fraction(r, n)) for r in rest]
    low = [float(Fraction(r, n) - Fraction(h)) for r, h in zip(rest, high)]
    return np.array(whole, np.int64), list(rest), np.array(high), np.array(low)


def centred(x: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean, in double-double."""
    whole, _, high, low = parts
    y = x - whole
    yh = y.astype(float)
    yl = (y - yh.astype(np.int64)).astype(float)
    return add((yh, yl), (-np.broadcast_to(high, y.shape), -np.broadcast_to(low, y.shape)))


def fit(rows: DataFrame, d: int, scale: float = 64.0, offset: int = 1_000_000, components: int = 32) -> Whitening:
    """The covariance's leading components over all rows (id, v)."""

    def sums(batches):
        n, s = 0, [0] * d
        for batch in batches:
            x = whole_numbers(batch, d, scale, offset)
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF
            s = [a + (b << 32) + c for a, b, c in zip(s, high.sum(0).tolist(), low.sum(0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))], ["i", "n", "s"]
            )

    found = rows.mapInArrow(sums, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect() if d else []
    n, exact = (found[0]["n"] if found else 0), [int(r["s"]) for r in found]
    if not n:
        return Whitening(0, [], scale, offset, np.zeros(0), np.zeros((d, 0)), 0.0)
    parts = mean_parts(n, exact)
    high, low = summed_products(rows, d, lambda batch: centred(whole_numbers(batch, d, scale, offset), parts))
    values, vectors = eigen((high + low) / n)
    real = min(components, int((values > d * 2.0**-52 * max(values[0], 0)).sum()))
    return Whitening(n, exact, scale, offset, values[:real], vectors[:, :real], float(sum(Fraction(t) for t in [*np.diag(high), *np.diag(low)]) / n))


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """For each row, the sum of (n * x - S)^2, exactly; y is x less the whole part of the mean."""
    most = n * max(1, int(np.abs(y).max(initial=0))) + n
    if len(rest) * most * most < 2**63:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    return [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in y.tolist()]


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity.  They are centred; what their own mean still is goes too."""
    k, d, parts, project = len(model.values), len(model.sums), mean_parts(model.n, model.sums), model.project

    def columns(batch):
        high, low = centred(whole_numbers(batch, d, model.scale, model.offset), parts)
        w = (high + low) @ project
        w = np.column_stack([w, np.ones(len(w))])
        return w, np.zeros_like(w)

    high, low = summed_products(rows, k + 1, columns)
    c = (high + low) / model.n
    return float(np.abs(c[:k, :k] - np.outer(c[:k, k], c[:k, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str, vector: str, scale: float = 64.0, offset: int = 1_000_000, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of every vector and leading component."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, d = usable(vectors, key, vector)
    model = fit(rows, d, scale, offset, components)
    k = len(model.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    parts, project, error = mean_parts(model.n, model.sums), model.project, identity_error(rows, model)
    n, explained = model.n, model.values / model.trace

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = whole_numbers(part, d, scale, offset)
                high, low = centred(x, parts)
                w, m = (high + low) @ project, len(x)
                far = [Decimal(v) if v < 10**38 else None for v in deviations(x - parts[0], n, parts[1])]
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(far, pa.decimal128(38, 0)).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
