"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one entry from each of `books` full-dimensional codebooks.  The books are
trained one after the other on the residuals of a bounded sample; encoding keeps a beam of the best
partial sums.  Codes and the norms of what they stand for are stored.  A query scores a code by adding
up one looked-up inner product per book (for squared distances with the stored norm); each block of
rows passes its best `rerank` distinct vectors a query (and those tied with the last) on to exact scoring with the original
vectors, with all their ids.

Queries and coded rows are packed in blocks of a fixed size, and Spark brings every block of queries to every block of rows, so
memory is bounded whatever the number of either; a task keeps the best `top` of the blocks it has seen.

Rows: vectors that are null, empty, zero, of another dimension than the sample's most common one, or hold null or
non-finite components take no part.  Repeated ids are separate candidates but never match their own
id; fewer candidates than wanted are all returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BLOCK = 4096
HELD = 400


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0"
    ).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x (zeros beyond their number)."""
    start = rng.permutation(len(x))[:k]
    centres = np.zeros((k, x.shape[1]), x.dtype)
    centres[: len(start)] = x[start]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        held = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def train_books(sample: np.ndarray, books: int, size: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (books, size, dimension), each trained on what the ones before leave over."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        c = kmeans(rest, size, rounds, rng)
        rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c * c).sum(1), axis=1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) and squared norms of their sums, by beam search over the books in turn."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    gram, norms = flat @ flat.T, (flat * flat).sum(1)
    dots = x.astype(np.float32) @ flat.T
    n = len(x)
    codes = np.zeros((n, 1, 0), np.int64)
    cost = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 <x, sum>
    for b in range(m):
        own = slice(b * k, (b + 1) * k)
        add = np.repeat((norms[own] - 2 * dots[:, own])[:, None, :], codes.shape[1], axis=1)
        for j in range(b):
            add += 2 * gram[j * k + codes[:, :, j], own]
        total = (cost[:, :, None] + add).reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
        cost = np.take_along_axis(total, best, 1)
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], axis=2)
    top = np.take_along_axis(codes, cost.argmin(1)[:, None, None], 1)[:, 0]
    sums = sum(books[j][top[:, j]] for j in range(m))
    return top, (sums * sums).sum(1)


def build(vectors: DataFrame, books: int = 16, size: int = 256, beam: int = 4, sample_rows: int = 8000) -> tuple[DataFrame, np.ndarray]:
    """The coded table (vec_id, v, codes, norm) of every usable row, and the codebooks, fitted on sample_rows rows."""
    good = usable(vectors)
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()["v"]  # bounded
    wide = pd.Series([len(v) for v in rows]).mode()
    d = int(wide[0]) if len(wide) else 1
    sample = np.array([v for v in rows if len(v) == d], np.float64).reshape(-1, d)
    trained = train_books(sample, books, size) if len(sample) else np.zeros((books, size, d), np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(trained)  # of fixed size

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).values.slice(part.column(1).offsets[0].as_py(), part.num_rows * d).to_numpy().reshape(-1, d)
                codes, norms = encode(x, shared.value, beam)
                flat = pa.array(codes.astype(np.int16).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * books, flat), pa.array(norms, pa.float32())],
                    ["vec_id", "v", "codes", "norm"],
                )

    coded = good.where(F.size("v") == d).mapInArrow(run, "vec_id long, v array<double>, codes array<short>, norm float")
    return stash(coded), trained


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), len(column) * width).to_numpy(zero_copy_only=False).reshape(-1, width)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of each distinct vector; all ids, by vector and then by size; where each vector's ids start, and their number at last."""
    x = np.ascontiguousarray(x)
    _, first, of = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    return first, ids[order], np.append(0, np.cumsum(np.bincount(of, minlength=len(first))))


def scan(queries, block, books: np.ndarray, top: int, rerank: int, metric: str):
    """(query id, vec_id, score) arrays: per query the exact best `top` of all rows of the block's `rerank` best distinct vectors.

    The block is (ids, starts) of distinct_rows() and the vectors, codes and norms of its distinct vectors.  Vectors whose codes
    tie with the last of them are scored as well.
    """
    qids, q = queries
    ids, starts, x, codes, norms = block
    tables = np.einsum("qd,mkd->mqk", q.astype(np.float32), books)
    rough = np.zeros((len(q), len(x)), np.float32)
    for j in range(len(books)):
        rough += tables[j][:, codes[:, j]]
    if metric == "l2":
        rough = 2 * rough - norms
    held, least = np.diff(starts), ids[starts[:-1]]
    rough[(qids[:, None] == least) & (least == ids[starts[1:] - 1])] = -np.inf
    keep = min(rerank, len(x))
    best = np.argpartition(-rough, keep - 1, axis=1)[:, :keep] if keep < len(x) else np.tile(np.arange(keep), (len(q), 1))
    score = lambda q, v: np.einsum("qd,qrd->qr", q, v) if metric != "l2" else -((q[:, None, :] - v) ** 2).sum(2)
    cut = np.take_along_axis(rough, best, 1).min(1)
    plain = ((rough >= cut[:, None]).sum(1) <= keep) & (held[best] == 1).all(1)
    at, near = qids[plain], best[plain]
    exact = np.where(at[:, None] == least[near], -np.inf, score(q[plain], x[near]))
    order = np.lexsort((least[near], -exact), axis=1)[:, :top]
    exact, found = np.take_along_axis(exact, order, 1), np.take_along_axis(least[near], order, 1)
    live = np.isfinite(exact)
    out = [(np.repeat(at, live.sum(1)), found[live], exact[live])]
    for i in np.flatnonzero(~plain):
        near = np.flatnonzero(rough[i] >= cut[i])
        exact = np.repeat(score(q[i : i + 1], x[None, near])[0], held[near])
        found = ids[np.repeat(starts[near] - np.append(0, np.cumsum(held[near])[:-1]), held[near]) + np.arange(len(exact))]
        other = (found != qids[i]) & np.isfinite(exact)
        exact, found = exact[other], found[other]
        order = np.lexsort((found, -exact))[:top]
        out.append((np.full(len(order), qids[i]), found[order], exact[order]))
    return tuple(np.concatenate(v) for v in zip(*out))


def in_rows(coded: DataFrame, width: int, count: int) -> DataFrame:
    """The coded table in rows of about BLOCK vectors: (ids, starts) of distinct_rows(), then vectors, codes and norms of the distinct vectors."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            ids, x = t.column(0).to_numpy(), matrix(t.column(1).chunk(0), width)
            first, ids, starts = distinct_rows(ids, x)
            parts = ids, starts, x[first], matrix(t.column(2).chunk(0), count)[first], t.column(3).to_numpy()[first]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["ids", "starts", "x", "codes", "norms"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(h.num_rows for h in held) >= BLOCK:
                    yield out()
        if held:
            yield out()

    return coded.mapInArrow(run, "ids binary, starts binary, x binary, codes binary, norms binary")


def search(
    coded: DataFrame, books: np.ndarray, queries: DataFrame, top: int = 20, rerank: int = 320, metric: str = "ip", query_block: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query (vec_id, v): the largest inner products, or ("l2") smallest distances, negated."""
    spark, width, count = coded.sparkSession, books.shape[2], books.shape[0]
    queries = queries.where(F.size("v") == width).select("vec_id", "v").distinct()
    n = max(1, -(-queries.count() // query_block))

    def pack(key, table):
        q = matrix(table.column("v").combine_chunks(), width)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "qids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "q": pa.array([q.tobytes()], pa.binary())})

    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(pack, "block int, qids binary, q binary")
    shared = spark.sparkContext.broadcast(books)  # of fixed size

    def run(batches):
        best: dict[int, list] = {}

        def out():
            for found in best.values():
                at, ids, exact = (np.concatenate(v) for v in zip(*found))
                order = np.lexsort((ids, -exact, at))
                at, ids, exact = at[order], ids[order], exact[order]
                heads = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
                nth = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
                yield pa.RecordBatch.from_arrays([pa.array(v[nth < top]) for v in (at, ids, exact)], ["query_id", "vec_id", "score"])
            best.clear()

        for batch in batches:
            for row in batch.to_pylist():
                qids, q = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["q"], np.float64).reshape(-1, width)
                ids, starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
                block = ids, starts, np.frombuffer(row["x"], np.float64).reshape(-1, width), np.frombuffer(row["codes"], np.int16).reshape(-1, count), np.frombuffer(row["norms"], np.float32)
                found = best.setdefault(row["block"], [])
                for at in range(0, len(q), 256):
                    found.append(scan((qids[at : at + 256], q[at : at + 256]), block, shared.value, top, rerank, metric))
                if sum(map(len, best.values())) > HELD:
                    yield from out()
        yield from out()

    # the stated queries against all rows, block by block
    pairs = stash(in_rows(coded, width, count)).crossJoin(stash(asked))
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """The `top` nearest rows of each row whose vec_id is divisible by `every`, by inner product."""
    coded, books = build(vectors)
    return search(coded, books, coded.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v"), top)
