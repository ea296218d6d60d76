"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-cased words.  Each mask picks five of the words in a short span and ignores the
others; equal seeds of a document and a benchmark item align the two.  Around every such hit, aligned words
are compared, and the document is contaminated if some window of `window` words (the whole item, if
shorter) that touches the hit agrees in at least `similarity` of them.

No window that agrees well enough is lost: two substitutions in 13 words (or in 10 to 12) leave a mask whole, and so does one in 8
or 9.  Items of five to seven words, in which one word may differ, are sought by four masks of four words as well, if there are any.

All documents' seeds pass a Bloom filter of the benchmark's seeds, of 16 bits a seed at least and 2**MOST_BITS in all; what
passes is joined on the seed, by whichever join Spark picks.  A seed that many items hold (a stock phrase) is dealt out by item.

Rows: null texts and items have no words.  Items of fewer than five words have no seed and can't be told
from common phrases; they are reported by items_without_seeds().  Repeated rows count once per id; documents with a null doc_id are
searched as well and reported together under null, and each stays or goes by its own text; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import stash

MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 4, 6, 7), (0, 2, 4, 6, 8))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))  # for items of five to SHORT words
LEAST, SHORT = 5, 7
WORD = re.compile(r"\w+")
KEPT = 300_000
LEAST_BITS, MOST_BITS = 20, 30
MANY = 64
BLOCK_BITS = 12  # words of the filter that come to the driver in one row, as a power of two
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Words:
    """Nonzero 64-bit hashes of a text's words; keeps those of words it has met."""

    def __init__(self):
        self.met: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if len(self.met) > KEPT:
            self.met.clear()
        for w in set(words).difference(self.met):
            self.met[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1) | 1
        return np.fromiter(map(self.met.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, short: bool):
    """(span, seed at each start) for every mask that fits, those of short items only if wanted."""
    for m, mask in enumerate(MASKS + SHORT_MASKS if short else MASKS):
        n = len(words) - mask[-1]
        if n > 0:
            h = np.full(n, m + 1, np.uint64)
            for odd, off in zip(ODD, mask):
                h = (h ^ words[off : off + n]) * odd
                h ^= h >> np.uint64(29)
            yield mask[-1] + 1, h


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two Bloom filter bits of each seed."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h * ODD[0]) >> np.uint64(64 - bits)).astype(np.int64)


def around(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """(hits, 2 * window + 8) words from `window` before each start; zero beyond the text."""
    padded = np.concatenate([np.zeros(window, np.uint64), words, np.zeros(window + 9, np.uint64)])
    return padded[at[:, None] + np.arange(2 * window + 8)]


def rows_of(ids: list, seed: list, span: list, near: list, width: int, extra: list[list]) -> pa.RecordBatch:
    flat = np.concatenate(near) if near else np.empty((0, width), np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64)),
            pa.array(np.concatenate(seed).view(np.int64) if seed else np.empty(0, np.int64)),
            pa.array(np.concatenate(span) if span else np.empty(0, np.int32)),
            pa.array([r.tobytes() for r in flat], pa.binary()),
            *[pa.array(np.concatenate(e) if e else np.empty(0, np.int32)) for e in extra],
        ],
        ["id", "seed", "span", "near", *["words"] * len(extra)],
    )


def item_seeds(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, seed, near2, words): every seed of every item with the words around it."""

    def run(batches):
        hashed, width = Words(), 2 * window + 8
        for batch in batches:
            ids, seed, span, near, n = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = hashed(t)
                if len(w) < LEAST:
                    continue
                for wide, h in seeds(w, len(w) <= SHORT):
                    ids.append(np.full(len(h), i, np.int64))
                    seed.append(h)
                    span.append(np.full(len(h), wide, np.int32))
                    near.append(around(w, np.arange(len(h)), window))
                    n.append(np.full(len(h), len(w), np.int32))
            yield rows_of(ids, seed, span, near, width, [n])

    return (
        benchmark.where("item_id is not null")
        .select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(run, "id long, seed long, span int, near binary, words int")
        .select(F.col("id").alias("item_id"), "seed", F.col("near").alias("near2"), "words")
    )


def bloom(seeds_of_items: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2**bits bits, put together in Spark word by word."""

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(probes(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], ["word", "bit"])

    def fill(table: pa.Table) -> pa.Table:
        word = table.column("word").to_numpy()
        out = np.zeros(1 << BLOCK_BITS, np.uint32)
        np.bitwise_or.at(out, word & ((1 << BLOCK_BITS) - 1), table.column("bit").to_numpy().astype(np.uint32))
        return pa.table({"block": pa.array(word[:1] >> BLOCK_BITS), "bits": pa.array([out.tobytes()], pa.binary())})

    words = seeds_of_items.select("seed").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    blocks = words.groupBy(F.shiftright("word", BLOCK_BITS).alias("block")).applyInArrow(fill, "block long, bits binary")
    out = np.zeros(1 << (bits - 5), np.uint32)
    for row in blocks.toLocalIterator():
        at = row["block"] << BLOCK_BITS
        out[at : at + (1 << BLOCK_BITS)] = np.frombuffer(row["bits"], np.uint32)
    return out.view(np.uint8)


def matches(docs: DataFrame, benchmark: DataFrame, key: str, window: int = 13, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, agreeing, window, hits): every value of the column `key` of docs and item with a window that agrees well enough."""
    items = stash(item_seeds(benchmark, window))
    n, least = items.agg(F.count("*"), F.min("words")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    short = least is not None and least <= SHORT
    shared = docs.sparkSession.sparkContext.broadcast(bloom(items, bits))  # 2**MOST_BITS bits at most

    def search(batches):
        hashed, width = Words(), 2 * window + 8
        filled = np.unpackbits(shared.value, bitorder="little").view(bool) if bits <= 24 else None
        found = (lambda at: filled[at]) if bits <= 24 else (lambda at: shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)
        for batch in batches:
            ids, seed, span, near, held = [], [], [], [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = hashed(t)
                for wide, h in seeds(w, short):
                    a, b = probes(h, bits)
                    at = np.flatnonzero(found(a))
                    at = at[found(b[at])]
                    for k in range(0, len(at), 4096):
                        part = at[k : k + 4096]
                        ids.append(np.full(len(part), i, np.int64))
                        seed.append(h[part])
                        span.append(np.full(len(part), wide, np.int32))
                        near.append(around(w, part, window))
                        held += len(part)
                        if held >= 16384:
                            yield named(rows_of(ids, seed, span, near, width, []), batch)
                            ids, seed, span, near, held = [], [], [], [], 0
            yield named(rows_of(ids, seed, span, near, width, []), batch)

    def named(rows, batch):
        """The rows with the ids of the batch's documents in place of their numbers."""
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows.column(0)), *rows.columns[1:]], rows.schema.names)

    hits = (
        docs.select(F.col(key).alias("id"), F.col("text").cast("string"))
        .mapInArrow(search, f"id {docs.schema[key].dataType.simpleString()}, seed long, span int, near binary")
        .withColumnRenamed("id", "doc_id")
    )

    def verify(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("near", "near2"))
            same = np.concatenate([np.zeros((len(a), 1), np.int64), np.cumsum((a == b) & (a != 0), axis=1)], axis=1)
            span, size = batch.column("span").to_numpy(), np.minimum(batch.column("words").to_numpy(), window)
            best = np.zeros(len(a), np.int64)
            for w in np.unique(size):
                rows = np.flatnonzero(size == w)
                # windows that start after `window` - w places and hold at least one place of the hit
                starts = np.arange(window - w + 1, 2 * window + 8 - w + 1)
                n = same[rows][:, starts + w] - same[rows][:, starts]
                n[starts[None, :] >= window + span[rows][:, None]] = 0
                best[rows] = n.max(1)
            fine = best >= np.ceil(similarity * size - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(fine)) for c in (batch.column("doc_id"), batch.column("item_id"), pa.array(best.astype(np.int32)), pa.array(size.astype(np.int32)))],
                ["doc_id", "item_id", "agreeing", "window"],
            )

    # a seed of many items is dealt to parts by item, and its hits are held against each part; a seed of many hits is Spark's to split
    often = items.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("seed", F.ceil(F.col("n") / MANY).cast("int").alias("parts"))
    parts = items.join(often, "seed", "left").withColumn("part", F.pmod(F.xxhash64("item_id", "near2"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spread = hits.join(often, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return (
        spread.join(parts, ["seed", "part"])
        .select("doc_id", "item_id", "span", "words", "near", "near2")
        .mapInArrow(verify, f"doc_id {docs.schema[key].dataType.simpleString()}, item_id long, agreeing int, window int")
        .groupBy("doc_id", "item_id")
        .agg(F.max("agreeing").alias("agreeing"), F.max("window").alias("window"), F.count("*").alias("hits"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, agreeing, window, hits): every document and item with a window that agrees well enough."""
    return matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "doc_id", window, similarity)


def items_without_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id of the items with fewer than five words."""
    return benchmark.where(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)(\w+)"), 1)) < LEAST).select("item_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark passage; a row goes by its text, whatever its doc_id."""
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    bad = matches(docs.select(digest.alias("digest"), "text"), benchmark, "digest").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, digest == F.col("_bad"), "left_anti")
