"""Packing documents into token sequences: dominance reduction, then best fit, both over the lengths' histogram.

A document's ids with an end id are cut into pieces of the capacity; what matters then of a piece is its
length, of which there are no more than the capacity.  The driver plans on the counts by length alone, a
summary that doesn't grow with the input: whole sets of pieces are permanently fixed where they dominate every
alternative (Martello and Toth's reduction), the rest is packed best fit, longest first.  Equal sequences are
one pattern with a number of times, so the plan too is bounded by the capacity.  Spark numbers the pieces of each length
and looks up each number's place.

Dominance: with piece j in a sequence, a set {j} + P is as good as any other set {j} + R that fits, if the pieces of R can be
shared out among those of P so that none of P is shorter than its share: exchanging them in any packing costs nothing.

Rows: null text is empty and has the end id alone; repeated rows and repeated or null ids are packed one by one; extra
columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import portions, vocabulary
from .common import stash

Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences, and their (length, pieces of it)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, in pieces of the capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        v, last = vocabulary(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in portions(texts):
                rows, cuts = [], []
                for i, packed in enumerate(v.encode_all(texts[part])):
                    packed += last
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        cut = packed[at : at + 4 * capacity]
                        rows.append((part.start + i, k, at // 4, len(cut) // 4, crc32(cut)))
                        if with_ids:
                            cuts.append(np.frombuffer(cut, "<u4").astype(np.int32))
                at, k, start, length, crc = map(np.array, zip(*rows))
                out = [doc_ids.take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(cuts, pa.list_(pa.int32()))], [*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def dominant(count: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """The lengths to put with a piece of length j, where one set dominates all others, of pieces counted by length."""
    free = count.copy()
    free[j] -= 1
    room = capacity - j
    have = np.flatnonzero(free)
    if not len(have) or have[0] > room:
        return []  # nothing fits
    least = np.repeat(have[:3], np.minimum(free[have[:3]], 3))[:3].tolist() + [capacity + 1] * 3
    best = int(have[np.searchsorted(have, room, "right") - 1])
    if best == room or least[0] + least[1] > room:
        return [best]  # it fills the sequence, or one piece is all that fits
    if sum(least[:3]) <= room:
        return None  # three fit: no set of two need dominate
    # the longest pair: for each a the longest b <= a that still fits
    b = np.minimum(have, room - have)
    b = np.where((b == have) & (free[have] < 2), b - 1, b)
    at = np.searchsorted(have, b, "right") - 1
    pairs = np.where((at >= 0) & (b > 0), have + have[np.maximum(at, 0)], 0)
    longest = int(pairs.max())
    if best >= longest:
        return [best]
    at_best = int(np.searchsorted(have, best))
    if pairs[at_best] == longest:
        second = longest - best
        longer = have[have > second]
        two = np.repeat(longer[:2], np.minimum(free[longer[:2]], 2))[:2]
        if len(two) < 2 or two.sum() > room:
            return [best, second]  # in every pair that fits, the shorter piece is no longer than this one
    return None


def reduce_by_dominance(count: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """The patterns that dominance fixes, and the counts by length that are left.

    What makes a set dominant stays true while its pieces last, as taking pieces away only takes alternatives away: it is
    fixed as many times as its pieces allow.  Passes go from the longest to the shortest until one fixes nothing.
    """
    count, fixed = count.copy(), []
    moved = True
    while moved:
        moved = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                partners = dominant(count, j, capacity)
                if partners is None:
                    break
                need = Counter([j, *partners])
                times = min(int(count[s]) // k for s, k in need.items())
                for s, k in need.items():
                    count[s] -= times * k
                fixed.append((times, sorted(need.items(), reverse=True)))
                moved = True
    return fixed, count


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """The pieces one after the other, longest first, each to the fullest sequence where it fits; equal ones in one go."""
    open_: dict[int, list[Pattern]] = {}  # by the room left

    def put(times: int, inside: list[tuple[int, int]], room: int) -> None:
        if times:
            open_.setdefault(room, []).append((times, inside))

    for s in np.flatnonzero(count)[::-1].tolist():
        left = int(count[s])
        for room in sorted(r for r in open_ if r >= s):
            waiting, open_[room] = open_[room], []
            while waiting and left:
                times, inside = waiting.pop()
                each = room // s
                full = min(times, left // each)
                left -= full * each
                put(full, [*inside, (s, each)], room - each * s)
                if full < times and left:
                    put(1, [*inside, (s, left)], room - left * s)
                    full, left = full + 1, 0
                put(times - full, inside, room)
            open_[room] += waiting
            if not left:
                break
        each = capacity // s
        put(left // each, [(s, each)], capacity - each * s)
        if left % each:
            put(1, [(s, left % each)], capacity - left % each * s)
    return [p for room in sorted(open_) for p in open_[room]]


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences (Martello and Toth's L2, the best over all thresholds)."""
    size = np.arange(len(count))
    weight, bound = count * size, -(-int((count * size).sum()) // capacity)
    for t in range(0, capacity // 2 + 1):
        alone, half = int(count[size > capacity - t].sum()), int(count[(size > capacity // 2) & (size <= capacity - t)].sum())
        middle = (size >= t) & (size <= capacity // 2)
        room = half * capacity - int(weight[(size > capacity // 2) & (size <= capacity - t)].sum())
        bound = max(bound, alone + half + max(0, -(-(int(weight[middle].sum()) - room) // capacity)))
    return bound


@dataclass
class Plan:
    """Where the pieces of each length go: runs of their numbers, in order of (length, number)."""

    sequences: int = 0
    rows: dict[str, np.ndarray] = field(default_factory=dict)


def plan(count: np.ndarray, capacity: int) -> Plan:
    fixed, rest = reduce_by_dominance(count, capacity)
    runs, used, first = [], Counter(), 0
    for times, inside in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for s, each in inside:
            runs.append((s, used[s], each, first, offset))
            used[s] += times * each
            offset += s * each
        first += times
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(first, dict(zip(("length", "number", "each", "sequence", "offset"), columns)))


def place(rows: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces of these lengths with these numbers among their equals."""
    run = np.empty(len(length), np.int64)
    for s in np.unique(length):
        own = length == s
        lo, hi = np.searchsorted(rows["length"], [s, s + 1])
        run[own] = lo + np.searchsorted(rows["number"][lo:hi], number[own], "right") - 1
    within, each = number - rows["number"][run], rows["each"][run]
    return rows["sequence"][run] + within // each, rows["offset"][run] + within % each * length


def numbered(held: DataFrame) -> DataFrame:
    """held, a written table, with `number`: from 0 among the rows of equal length.

    Rows are numbered by their place in the file split they are read from, which no re-run changes; splits are told
    apart, so that one common length is shared out among as many tasks as there are splits of it.
    """
    rows = held.withColumn("_m", F.monotonically_increasing_id()).withColumn("_s", F.shiftright("_m", 33))
    before = Window.partitionBy("length").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_s").agg(F.count("*").alias("_n")).select("length", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("length", "_s").orderBy("_m")) - 1
    return rows.withColumn("_r", inside).join(starts, ["length", "_s"]).withColumn("number", F.col("_r") + F.col("_o")).drop("_m", "_s", "_r", "_o")


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset: as few sequences of the capacity as dominance and best fit need."""
    held = stash(cut)
    count = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").count().collect():  # no more rows than the capacity
        count[row["length"]] = row["count"]
    lookup = cut.sparkSession.sparkContext.broadcast(plan(count, capacity).rows)

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = place(lookup.value, length, number)
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {kind}" for c, kind in held.dtypes)
    return numbered(held).select(*held.columns, "number").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(pieces(docs, path, capacity, end), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the sequences themselves, with the documents and lengths of their pieces in order."""
    by = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))  # no more ids than the capacity
    return (
        pack(pieces(docs, path, capacity, end, with_ids=True), capacity)
        .groupBy("sequence_id").agg(by.alias("p"))
        .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
    )
