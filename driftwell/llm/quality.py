"""Quality classifier: logistic regression over hashed word n-grams, trained by follow the regularised leader.

Features of a text: its lower-cased white-space words, hashed single words and word pairs, and for every
word its shape (letters, digits, other characters and case, runs shortened), each in one of 2**BITS
places with a signed weight.  A text's vector is scaled to length one, so long texts count
like short ones; an empty text has the bias alone.

Training takes a bounded sample of the labelled rows (`max_rows`, smallest hashes of doc_id first).
Every epoch, each of `parts` groups of rows goes through the per-coordinate FTRL-proximal updates, and
the groups' states are averaged place by place.  Scoring is a sparse dot product per whole text.

Rows: null text scores as empty.  Null labels and labels of absent documents are left out.
Repeated rows are scored alike; extra columns are ignored.  An empty table gives an empty result, and with no
labelled row every score is one half.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

BITS = 18
SIZE = (1 << BITS) + 1  # the last place is the bias
KEPT = 300_000
CLASSES = bytes.maketrans(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + bytes(range(48, 58)), b"A" * 26 + b"a" * 154 + b"0" * 10)
RUNS = re.compile(rb"(.)\1+", re.S)


class Hasher:
    """Sparse vectors of texts; keeps the hashes of words it has met."""

    def __init__(self):
        self.met: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        shape = RUNS.sub(rb"\1", w.translate(CLASSES))
        return (zlib.crc32(w.lower()) << 32) | zlib.crc32(b"shape " + shape)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places and their values, of length one; (empty, empty) for no words."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        met = self.met
        if len(met) > KEPT:
            met.clear()
        for w in set(words).difference(met):
            met[w] = self.word(w)
        both = np.fromiter(map(met.__getitem__, words), np.uint64, len(words))
        if not len(both):
            return np.empty(0, np.int64), np.empty(0)
        one, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        again = np.count_nonzero(one[:-1] == one[1:])  # a word said twice running
        h = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), pair * np.uint64(0x9FB21C651E98DF25), shape * np.uint64(0xA0761D6478BD642F)])
        places, counts = np.unique((h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        values = np.sqrt(counts)
        if again:
            places, values = np.append(places, 0), np.append(values, np.sqrt(again))
        return places, values / np.sqrt(np.dot(values, values))


class Ftrl:
    """Per-coordinate FTRL-proximal state (z, n) for the logistic loss."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float, weight: float) -> float:
        """One row's update; its weighted loss before."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.dot(w, x), -35, 35)))
        g = (p - label) * weight * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return -weight * np.log(p if label else 1 - p)


def with_bias(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(at, SIZE - 1), np.append(x, 1.0)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after the other, and where each list starts."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)


def one_epoch(state, epoch: int, passes: int, enough: float, balance: dict[float, float], rates: tuple[float, ...]):
    """A function that takes one group of rows through the updates and returns the places that moved, and by how much."""

    def run(table: pa.Table) -> pa.Table:
        m = Ftrl(*(a.copy() for a in state.value), *rates)
        y, order = table.column("y").to_pylist(), np.argsort(table.column("_id").to_numpy(), kind="stable")
        (at, ends), (x, _) = flat(table.column("at")), flat(table.column("x"))
        rows = [(at[ends[i] : ends[i + 1]], x[ends[i] : ends[i + 1]], y[i]) for i in order.tolist()]
        rng = np.random.default_rng(epoch)
        for _ in range(passes):
            loss = sum(m.learn(*rows[i], balance[rows[i][2]]) for i in rng.permutation(len(rows)).tolist())
            if loss <= enough * len(rows):
                break
        moved = np.flatnonzero((m.z != state.value[0]) | (m.n != state.value[1]))
        return pa.table({"place": moved, "z": m.z[moved] - state.value[0][moved], "n": m.n[moved] - state.value[1][moved]})

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_rows: int = 12_000,
    epochs: int = 3,
    passes: int = 30,
    enough: float = 0.05,
    parts: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.1,
) -> np.ndarray:
    """Dense weights (2**BITS places and the bias) for P(label = 1), from at most max_rows labelled rows.

    Of several rows with one doc_id one is fitted, the one whose text has the least hash.  In each of `epochs` rounds, each of `parts` groups goes through its rows until a pass has a mean loss of `enough` or less, `passes` times at most.

    The two classes get equal total weight; half of their log odds goes to the bias afterwards.  With labels of one class only there is
    nothing to learn from a text: all weights are zero and the bias is 3 for class 1, -3 for class 0.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("double").alias("_y"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_t"))

    def vectors(batches):
        hasher = Hasher()
        for batch in batches:
            found = [with_bias(*hasher.vector(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    *[batch.column(i) for i in (1, 2)],
                ],
                ["at", "x", "y", "_id"],
            )

    rows = stash(
        texts.join(chosen, "_id").groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")).select("_t", "_y", "_id").mapInArrow(vectors, "at array<int>, x array<float>, y double, _id long")
    )
    odds = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two classes
    total = sum(odds.values())
    if len(odds) < 2:
        w = np.zeros(SIZE)
        if odds:
            w[-1] = 3.0 if 1.0 in odds else -3.0
        return w
    balance = {y: total / (2 * n) for y, n in odds.items()}
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    spread = rows.withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    parts = max(1, parts)
    for epoch in range(epochs):
        state = spread.sparkSession.sparkContext.broadcast((z, n))  # a fixed number of places

        step = spread.groupBy("part").applyInArrow(one_epoch(state, epoch, passes, enough, balance, (alpha, beta, l1, l2)), "place long, z double, n double").groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
        z[step["place"]] += step["z"] / parts
        n[step["place"]] += step["n"] / parts
    weights = Ftrl(z, n, alpha, beta, l1, l2).weights(slice(None))
    weights[-1] += np.log(odds[1.0] / odds[0.0]) / 2
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score: P(label = 1) of every whole text, a sparse dot product with the weights."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed number of places

    def run(batches):
        w, hasher = model.value, Hasher()
        for batch in batches:
            dots = []
            for t in batch.column(1).to_pylist():
                at, x = hasher.vector(t)
                dots.append(np.dot(w[at], x) + w[-1])
            p = 1 / (1 + np.exp(-np.clip(np.array(dots, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `least`."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, hasher = model.value, Hasher()
        for batch in batches:
            dots = []
            for t in batch.column("text").to_pylist():
                at, x = hasher.vector(t)
                dots.append(np.dot(w[at], x) + w[-1])
            yield batch.filter(pa.array(np.array(dots, np.float64) >= np.log(least / (1 - least))))

    return docs.mapInArrow(run, docs.schema)


def fold(remainder: int, modulus: int, column: str = "doc_id"):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; trained on labels of rows that are not held out."""
    weights = train(docs, labels.where(~fold(1, 3)))
    return score(docs, weights).select(
        "doc_id", fold(1, 3).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )
