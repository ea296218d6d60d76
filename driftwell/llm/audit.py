"""Filter interaction audit: what five quality filters remove together, alone and in every order.

A document fails some of the filters; `audit` needs only how many documents of a part fail exactly each set of them
(its mask).  The removal polynomial of a part is multilinear: with filter i applied with probability x_i it removes

    F(x) = sum over masks of count * (1 - product over i in the mask of (1 - x_i))

documents on average.  Its values at the corners of the cube are what sets of filters remove, so differences between
corners give each step of each order.  The Shapley value of filter i is the integral of the partial derivative by x_i
along the diagonal, taken with exact rationals; times the number of orders it is the sum over all of them.

Rows: null text is empty; a null source and an empty one are one part.  A null doc_id is neither smaller nor larger
than any other and has no label; rows with equal doc_id and text are not each other's earlier copy.  A document with
several label rows is good (toxic) if any of them says so.  Extra columns take no part; an empty table has no parts.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

FILTERS = "ABCDE"
BLANK = "[\\x20\\x09-\\x0D]+"
STEPS = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failing = [n < 200, 100 * kinds < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the exact set of filters they fail.

    Texts are read once and leave as hashes.  Equal rows are counted before any shuffle by key.  A text's
    smallest doc_id is joined back on (text, doc_id), not on the text, so a group of copies of any size is spread; and
    labels meet at most one row a (doc_id, part, mask).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_t")
    ).select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("text"), text_mask(F.col("_t")).alias("mask"))
    seen = stash(rows.groupBy("text", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    first = seen.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    masked = seen.join(first, ["text", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), "n")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    counts = (
        masked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
        .join(marks, "doc_id", "left")
        .groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("good").alias("good"), weighed("toxic").alias("toxic"))
    )
    out = stash(counts)
    drop_stash(seen)
    return out


def removal_polynomial(counts: np.ndarray) -> np.ndarray:
    """The coefficient of each product of x_i, i in S, by S as a bit set, of a part whose masks have these counts."""
    sets = np.arange(len(counts))
    over = (sets[:, None] & sets) == sets[:, None]  # over[S, mask]: the mask holds all of S
    odd = np.array([bin(s).count("1") % 2 for s in sets])
    return np.where(sets == 0, 0, np.where(odd == 1, 1, -1) * (over @ counts))


def corners(coefficients: np.ndarray) -> np.ndarray:
    """The polynomial at each corner: x_i is 1 for i in the set and 0 elsewhere."""
    sets = np.arange(len(coefficients))
    return ((sets[:, None] & sets) == sets) @ coefficients


def shapley(coefficients: np.ndarray, i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by x_i at x = (t, ..., t)."""
    powers: dict[int, int] = {}  # the derivative along the diagonal, by power of t
    for s, c in enumerate(coefficients.tolist()):
        if s >> i & 1:
            k = bin(s).count("1") - 1
            powers[k] = powers.get(k, 0) + c
    return sum((Fraction(c, k + 1) for k, c in powers.items()), Fraction(0))


def every_step(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """A part's rows, one for each step of each order of the filters, from its counts by mask."""
    order = np.array(list(permutations(range(len(filters)))))
    bit = 1 << order
    after = np.cumsum(bit, axis=1)
    before = after - bit
    poly = removal_polynomial(n)
    gone, good_gone, toxic_gone = (corners(removal_polynomial(c)) for c in (n, good, toxic))
    every = len(n) - 1
    removed = gone[after] - gone[before]
    worth = [shapley(poly, i) * factorial(len(filters)) for i in range(len(filters))]
    return {
        "filter_order": np.repeat(["".join(filters[i] for i in o) for o in order], len(filters)),
        "step": np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(order)),
        "kept": (int(n.sum()) - gone[after]).ravel(),
        "removed": removed.ravel(),
        "redundant": (gone[bit] - removed).ravel(),
        "unique_fails": (gone[every] - gone[every - bit]).ravel(),
        "good_lost": (good_gone[after] - good_gone[before]).ravel(),
        "toxic_lost": (toxic_gone[after] - toxic_gone[before]).ravel(),
        "shapley": np.array([int(w) for w in worth])[order].ravel(),
    }


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of counts (part, mask, n, good, toxic)."""
    masks = 1 << len(FILTERS)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 32 entries at most

    def run(batches):
        for batch in batches:
            for part, entries in zip(batch.column("part").to_pylist(), batch.column("c").to_pylist()):
                by = np.zeros((3, masks), np.int64)
                for e in entries:
                    by[:, e["mask"]] += (e["n"], e["good"], e["toxic"])
                rows = every_step(*by)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows["step"])), *map(pa.array, rows.values())], ["part", *rows])

    return parts.mapInArrow(run, f"part string, {STEPS}")


#: The same from its definition: each step counts the documents that the filters before it have left.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), m AS (
  SELECT doc_id, part,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
), o AS (
  SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS letters, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT array_to_string(letters, '') AS filter_order, k::INT AS step, bits[k] AS bit, list_sum(bits[1:k])::BIGINT AS upto
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), r AS (
  SELECT part, filter_order, step, bit,
         (sum(n) FILTER (WHERE mask & upto = 0)) AS kept,
         (sum(n) FILTER (WHERE mask & bit > 0 AND mask & (upto - bit) = 0)) AS removed,
         (sum(n) FILTER (WHERE mask & bit > 0 AND mask & (upto - bit) > 0)) AS redundant,
         (sum(n) FILTER (WHERE mask = bit)) AS unique_fails,
         (sum(good) FILTER (WHERE mask & bit > 0 AND mask & (upto - bit) = 0)) AS good_lost,
         (sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & (upto - bit) = 0)) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
