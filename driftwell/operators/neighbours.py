"""Exact k nearest neighbours by a pivot join: points meet only those that the triangle inequality can't rule out.

Equal vectors are one point with its few smallest ids.  Each point belongs to the cell of its nearest pivot; points in
order of (cell, distance to the pivot) are cut in blocks, so a block is a ring around a pivot.  A point's distance to its
k-th neighbour is bounded from above by what lies with it in its part of a block, and by the rings next to any pivot.
It is then sent only to rings that may hold something nearer: by the ring's distances from its pivot, and by the plane
half-way between two pivots.  Vectors don't travel to meet: a task reads one file of points asked and one of points held, and sends
on what is nearest among those.  Pivots and rings are bounded in number, so what tasks are given doesn't grow with the table.

Rows: null keys, and vectors that are null, empty or hold null or non-finite entries take no part.  Of several rows with one
key the least vector counts, so repeated rows are one point.  Vectors of another length than most of these (of equally common
lengths the longest counts) take no part either.  Ties go to the smaller key.  Keys are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from driftwell.sources.tables import dropped, written

PART = 2048  # points packed in a row
PIVOTS = 1024  # cells at most
TOGETHER = 64  # parts in a file that a task holds while points are asked of it
RINGS = 1 << 16  # blocks at most, besides one a cell
SAMPLE = 16_384  # points that pivots are chosen from
HOT = 256  # a vector held by one in so many rows is joined apart from the others; there can't be more of them


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row a key, v an array of doubles."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be of an integral type")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    # minus zero becomes zero, so that equal vectors are equal
    v = F.transform(F.col(vector).cast("array<double>"), lambda c: c + F.lit(0.0))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def of_one_length(points: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(the distinct points of the commonest length, their number, that of their rows, the length)."""
    sizes = points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("d")).first()
    if not most:
        return points, 0, 0, 0
    return points.where(F.size("v") == most["d"]), most["n"], most["rows"], most["d"]


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, copies): each vector with its k + 1 smallest ids, merged in steps so that no task holds all ids of one vector."""
    least = lambda ids: F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, k + 1)

    def in_batch(batches):
        for batch in batches:
            by: dict[bytes, list[int]] = {}
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column("v").value_lengths().to_numpy())
            for i, row in zip(batch.column("id").to_pylist(), np.split(flat, ends[:-1])):
                by.setdefault(row.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([np.frombuffer(b, float) for b in by], pa.list_(pa.float64())),
                    pa.array([sorted(ids)[: k + 1] for ids in by.values()], pa.list_(pa.int64())),
                    pa.array([len(ids) for ids in by.values()], pa.int64()),
                ],
                ["v", "ids", "copies"],
            )

    some = rows.mapInArrow(in_batch, "v array<double>, ids array<long>, copies long").withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(64)))
    some = some.groupBy("v", "s").agg(least("ids").alias("ids"), F.sum("copies").alias("copies"))
    return some.groupBy("v").agg(least("ids").alias("ids"), F.sum("copies").alias("copies"))


def matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, by a matrix product: right to about slack() squared."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than rounding can change a distance of squared(), after its root."""
    return 1e-7 * (1e-9 + np.sqrt(max((x * x).sum(1).max(initial=0), (y * y).sum(1).max(initial=0))))


def choose_pivots(points: DataFrame, n: int, part: int, most: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """Centres of a bounded sample, as many as there are parts to fill."""
    sample = np.array([r["v"] for r in points.orderBy(F.xxhash64(F.element_at("ids", 1)), F.element_at("ids", 1)).limit(SAMPLE).select("v").collect()])
    k = min(most, -(-n // part), len(sample))
    centres = sample[:k]
    for _ in range(rounds if k > 1 else 0):
        near = np.argmin(squared(sample, centres), axis=1)
        held = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def packed(points: DataFrame, centres, n: int, d: int, part: int) -> DataFrame:
    """(cell, low, high, size, ids, owner, points): parts of up to `part` points of one cell, in order of distance from its pivot.

    owner is 1 for the smallest id of a vector, whose neighbours are sought, and 0 for its other ids.
    """

    def to_cells(batches):
        for batch in batches:
            x = matrix(batch.column("v"), d)
            if not len(x):
                continue
            near = np.argmin(squared(x, centres.value), axis=1)
            far = np.sqrt(((x - centres.value[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), batch.column("ids"), batch.column("v")], ["cell", "far", "ids", "v"])

    def pack(batches):
        held: list[pa.RecordBatch] = []
        cell, size = None, 0

        def out():
            ids = [i for b in held for i in b.column("ids").to_pylist()]
            x = np.concatenate([matrix(b.column("v"), d) for b in held])
            far = np.concatenate([b.column("far").to_numpy() for b in held])
            times = np.fromiter(map(len, ids), np.int64, len(ids))
            owner = np.zeros(times.sum(), np.int8)
            owner[np.cumsum(times) - times] = 1
            row = {"cell": cell, "low": far.min(), "high": far.max(), "size": len(owner), "ids": np.concatenate(ids).astype(np.int64).tobytes()}
            return pa.RecordBatch.from_pylist([row | {"owner": owner.tobytes(), "points": np.repeat(x, times, axis=0).tobytes()}], arrow)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (cells[a] != cell or size >= part):
                        yield out()
                        held, size = [], 0
                    take = min(b - a, part - size)
                    held.append(batch.slice(a, take))
                    cell, size, a = int(cells[a]), size + take, a + take
        if held:
            yield out()

    schema = "cell int, low double, high double, size long, ids binary, owner binary, points binary"
    arrow = pa.schema([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("size", pa.int64()), ("ids", pa.binary()), ("owner", pa.binary()), ("points", pa.binary())])
    cells = points.mapInArrow(to_cells, "cell int, far double, ids array<long>, v array<double>")
    first = F.element_at("ids", 1)
    dealt = cells.repartitionByRange(max(1, n // (16 * part)), "cell", "far", first).sortWithinPartitions("cell", "far", first)
    return dealt.mapInArrow(pack, schema)


def with_rings(parts: DataFrame, n: int, part: int, rings: int = RINGS) -> tuple[DataFrame, list]:
    """The parts with `ring`, a number shared by consecutive parts of a cell, and (ring, cell, low, high, size) of each ring.

    A ring is one part until there are more parts than rings; then it holds several.
    """
    each = -(-(n // part) // rings) or 1
    order = F.row_number().over(Window.partitionBy("cell").orderBy("low", "high", "ids")) - 1
    ends = parts.select("cell", "low", "high", "ids", "size").withColumn("ring", F.concat_ws("/", "cell", F.floor(order / each)))
    of = ends.select(F.col("cell").alias("_c"), F.col("ids").alias("_i"), "ring")
    named = parts.join(of, (F.col("cell") == F.col("_c")) & (F.col("ids") == F.col("_i"))).drop("_c", "_i")
    known = ends.groupBy("ring", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size")).orderBy("cell", "low", "high", "ring").collect()
    return named, known


class Rings:
    """What a task knows of all rings: their pivots, distances from them, and how near enough points of a cell lie."""

    def __init__(self, centres: np.ndarray, known: list, k: int):
        self.centres, self.names = centres, [r["ring"] for r in known]
        self.cell = np.array([r["cell"] for r in known], np.int64)
        self.low, self.high = np.array([r["low"] for r in known]), np.array([r["high"] for r in known])
        self.enough = np.full(len(centres), np.inf)  # from a pivot: a distance within which lie k + 1 points of its cell
        held = np.zeros(len(centres), np.int64)
        reach = np.zeros(len(centres))
        for r in known:
            c = r["cell"]
            held[c] += r["size"]
            reach[c] = max(reach[c], r["high"])
            if held[c] > k and np.isinf(self.enough[c]):
                self.enough[c] = reach[c]
        self.between = np.sqrt(squared(centres, centres))

    def bound(self, to_pivots: np.ndarray) -> np.ndarray:
        """No point's (k + 1)-th neighbour, itself the first, is farther than this."""
        return (to_pivots + self.enough).min(1)

    def needed(self, to_pivots: np.ndarray, own: int, bound: np.ndarray, off: float, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(points x rings): whether a ring, of all or some of them, may hold a point within the bound."""
        u, cell = bound[:, None] + off, self.cell[of]
        near = to_pivots[:, cell]
        out = (near - self.high[of] <= u) & (self.low[of] - near <= u)
        gap = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to_pivots**2 - to_pivots[:, own : own + 1] ** 2) / (2 * gap)
        plane[:, gap <= off] = 0
        return out & (plane[:, cell] * (1 - 1e-6) <= u)


def nearest_in(x: np.ndarray, bound: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, distance) of the k nearest of y to each row within its bound, by distance and id.

    What the matrix product leaves within rounding of the k-th or the bound is measured exactly.
    """
    rows, who, dist = [], [], []
    off = slack(x, y)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        d = squared(part, y)
        cut = bound[at : at + 512] + 2 * off
        i, j = np.divmod(np.flatnonzero(d <= (cut * cut * (1 + 1e-12))[:, None]), len(y))
        if len(i) > 4 * k * len(part) and k < len(y):
            cut = np.minimum(cut, np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1]) + 2 * off)
            i, j = np.divmod(np.flatnonzero(d <= (cut * cut * (1 + 1e-12))[:, None]), len(y))
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            exact[a : a + (1 << 16)] = np.sqrt(((part[i[a : a + (1 << 16)]] - y[j[a : a + (1 << 16)]]) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        rows.append(i[keep] + at)
        who.append(ids[j[keep]])
        dist.append(exact[keep])
    return np.concatenate(rows), np.concatenate(who), np.concatenate(dist)


def asked(parts: DataFrame, rings, d: int, k: int) -> DataFrame:
    """(cell, asked, wanted, bound, need): each part's points whose neighbours are sought, packed, and which rings may hold some of those."""

    def run(batches):
        r: Rings = rings.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, owner = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owner"], np.int8) > 0
                y = np.frombuffer(row["points"], float).reshape(-1, d)
                x, own = y[owner], ids[owner]
                if not len(x):
                    continue
                off = slack(x, r.centres)
                to_pivots = np.sqrt(squared(x, r.centres))
                bound = r.bound(to_pivots)
                if len(y) > k:
                    home = np.sqrt(np.concatenate([np.partition(squared(x[at : at + 512], y), k, axis=1)[:, k] for at in range(0, len(x), 512)]))
                    bound = np.minimum(bound, home)
                bound = bound + 4 * off
                need = np.zeros(len(r.cell), bool)
                for at in range(0, len(x), 64):
                    need |= r.needed(to_pivots[at : at + 64], row["cell"], bound[at : at + 64], 4 * off).any(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["cell"]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (own, x, bound)], pa.array([need], pa.list_(pa.bool_()))],
                    ["cell", "asked", "wanted", "bound", "need"],
                )

    return parts.select("cell", "ids", "owner", "points").mapInArrow(run, "cell int, asked binary, wanted binary, bound binary, need array<boolean>")


def rings_of(points: DataFrame, n: int, d: int, k: int, part: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(the points asked, the parts that they are asked of with the numbers of their rings, both by pairs that may meet; what tasks know of rings; written tables).

    Both are written in files of few parts, so that they can meet without travelling: every two files are read by one task.
    """
    context = points.sparkSession.sparkContext
    centres = context.broadcast(choose_pivots(points, n, part))
    parts = written(packed(points, centres, n, d, part))
    named, known = with_rings(parts, n, part)
    rings = context.broadcast(Rings(centres.value, known, k))
    number = {r["ring"]: i for i, r in enumerate(known)}
    numbers = points.sparkSession.createDataFrame(list(number.items()), "ring string, number int")
    there = named.select("ring", "ids", "points").join(F.broadcast(numbers), "ring").select("number", "ids", "points")
    size = n // part + 1
    held = written(there.repartition(-(-size // TOGETHER), "number"))
    asks = written(asked(parts.repartition(min(size, -(-size // 2), 1024), "ids"), rings, d, k))
    return asks, held, rings, [parts, asks, held]


def pairs_of(asks: DataFrame, held: DataFrame) -> DataFrame:
    """Points asked and the parts that may hold their neighbours, side by side: a product of files, without a shuffle."""
    return asks.hint("shuffle_replicate_nl").join(held, F.element_at("need", F.col("number") + 1)).drop("need")


class Asked:
    """A part's points in a task: which of them a ring is asked about, and the nearest that are known so far."""

    def __init__(self, row: dict, rings: Rings, d: int, k: int):
        self.own, self.cell, self.k, self.rings = np.frombuffer(row["asked"], np.int64), row["cell"], k, rings
        self.x, self.bound = np.frombuffer(row["wanted"], float).reshape(-1, d), np.frombuffer(row["bound"], float).copy()
        self.off = 4 * slack(self.x, rings.centres)
        self.to_pivots = np.sqrt(squared(self.x, rings.centres))
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    def of(self, ring: int) -> np.ndarray:
        """The points that the ring may hold neighbours of."""
        return np.flatnonzero(self.rings.needed(self.to_pivots, self.cell, self.bound, self.off, np.array([ring]))[:, 0])

    def meet(self, ring: int, ids: np.ndarray, y: np.ndarray) -> None:
        some = self.of(ring)
        if not len(some):
            return
        i, who, dist = nearest_in(self.x[some], self.bound[some], ids, y, self.k)
        i, who, dist = (np.concatenate(p) for p in zip(self.found, (some[i], who, dist)))
        order = np.lexsort((who, dist, i))
        i, who, dist = i[order], who[order], dist[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last, keep = place == self.k - 1, place < self.k
        self.bound[i[last]] = np.minimum(self.bound[i[last]], dist[last])
        self.found = [i[keep], who[keep], dist[keep]]

    def out(self) -> pa.RecordBatch:
        i, who, dist = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.own[i]), pa.array(who), pa.array(dist)], ["id", "neighbour", "distance"])


def self_join(points: DataFrame, n: int, d: int, k: int, part: int) -> tuple[DataFrame, list[DataFrame]]:
    """((id, neighbour, distance) of each distinct point's k + 1 nearest, itself and its copies included; the written tables it reads).

    A task goes through one file of points asked and one of points held; only what it found nearest to each point goes on.
    """
    asks, held, rings, tables = rings_of(points, n, d, k, part)

    def meet(batches):
        now, name = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if name != row["asked"]:
                    if now:
                        yield now.out()
                    now, name = Asked(row, rings.value, d, k + 1), row["asked"]
                now.meet(row["number"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["points"], float).reshape(-1, d))
        if now:
            yield now.out()

    found = pairs_of(asks, held).mapInArrow(meet, "id long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k + 1), tables


def neighbours(df: DataFrame, key: str, vector: str, k: int, part: int = PART) -> DataFrame:
    """(key, rank, neighbour, distance): each point's k nearest points other than itself, of the whole table, ties to the smaller key."""
    rows = usable(df, key, vector)
    table = written(distinct_points(rows, k))
    points, n, every, d = of_one_length(table)
    if not n:
        return df.sparkSession.createDataFrame([], "key long, rank int, neighbour long, distance double")
    found, tables = self_join(points, n, d, k, part)
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    of = written(lists.join(points.select(F.element_at("ids", 1).alias("id"), "v", "copies"), "id"))
    dropped(*tables, table)
    out = [of.where("copies = 1").select("id", "near")]
    if every > n:
        # a vector of very many rows is joined where the rows are, the others by their vectors
        copied, often = of.where("copies > 1").select("v", "near", "copies"), F.col("copies") * HOT >= every
        frequent = copied.where(often)
        out.append(rows.join(F.broadcast(frequent), "v").select("id", "near"))
        out.append(rows.join(F.broadcast(frequent.select("v")), "v", "left_anti").join(copied.where(~often), "v").select("id", "near"))
    others = F.slice(F.filter("near", lambda m: m["neighbour"] != F.col("id")), 1, k)
    ranked = [
        one.select(F.col("id").alias("key"), F.posexplode(others).alias("p", "m")).select(
            "key", (F.col("p") + 1).alias("rank"), F.col("m.neighbour").alias("neighbour"), F.col("m.distance").alias("distance")
        )
        for one in out
    ]
    if len(ranked) == 1:
        return ranked[0]
    result = written(*ranked)
    dropped(of)
    return result


def pairs_met(df: DataFrame, key: str, vector: str, k: int, part: int = PART) -> int:
    """How many pairs of points neighbours() measures, for judging how much of the table it can leave out."""
    table = written(distinct_points(usable(df, key, vector), k))
    points, n, _, d = of_one_length(table)
    if not n:
        return 0
    asks, held, rings, tables = rings_of(points, n, d, k, part)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(Asked(r, rings.value, d, k + 1).of(r["number"])) * len(r["ids"]) // 8 for r in batch.to_pylist()], pa.int64())], ["met"])

    met = pairs_of(asks, held).mapInArrow(count, "met long").agg(F.sum("met")).first()[0]
    dropped(*tables, table)
    return int(met or 0)
