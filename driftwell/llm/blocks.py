"""Documents in blocks of bounded size, and questions between blocks.

A block asks what other blocks hold by sending sorted arrays of hashes, one packed row per hash bucket; a
bucket's task answers every block's row with one byte an entry, in the order asked.  The
block works out its entries again and lines the answers up, so texts are dealt out by block once (Spark
reuses the exchange) and never travel with the hashes.

As many buckets as blocks would mean rows in the square of the input.  Beyond FAN buckets rows go in two steps: a block sends
one row to each of FAN ranges of buckets, groups of FAN blocks turn what a range got into one row a bucket, and the
answers come back the same way.  A block then has at most FAN rows at either end, whatever the size of the input, and a
group holds about as much as a block sends.
"""

from __future__ import annotations

import gc
import inspect
from collections.abc import Callable, Iterable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
FAN = 4096
ASKED = "_block int, bucket int, data binary"


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """docs with a column _block (by hash of doc_id and text, so that no id fills a block), and their number, in proportion to the text."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = total // block_bytes + 1
    return docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text", F.lit("block")), F.lit(n)).cast("int")), n


def utf8(table: pa.Table) -> list[bytes]:
    """The texts as bytes, straight from the Arrow buffers; null is empty."""
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def lean(run):
    """run, with the memory it leaves behind handed back before the worker waits for its next group."""

    def each(*tables):
        try:
            return run(*tables)
        finally:
            gc.collect(0)
            pa.default_memory_pool().release_unused()

    if len(inspect.signature(run).parameters) == 1:
        return lambda table: each(table)
    if len(inspect.signature(run).parameters) == 2:
        return lambda key, table: each(key, table)
    return lambda key, left, right: each(key, left, right)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket that rises with the hash, so that hashes in order are in order of bucket."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def planes(a: np.ndarray, width: int = 8) -> bytes:
    """The low `width` bytes of 8-byte items, all first bytes together, then all second ones, and so on.

    High bytes of sorted hashes, small counts and ids hardly change, so the shuffle's compression takes them away.
    """
    return a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(raw: bytes, kind, n: int, at: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel()


def asked(block: int, bucket: np.ndarray, *arrays: tuple[np.ndarray, int]) -> pa.Table:
    """Rows (_block, bucket, data) of entries already in order of bucket; arrays with the bytes to keep of their items."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    rows = [b"".join(planes(a[i:j], w) for a, w in arrays) for i, j in zip(cuts, cuts[1:])]
    return pa.table(
        {
            "_block": pa.array(np.full(len(rows), block, np.int32)),
            "bucket": pa.array(bucket[cuts[:-1]].astype(np.int32)),
            "data": pa.array(rows, pa.binary()),
        }
    )


def gathered(table: pa.Table, kinds: list[tuple[type, int]]) -> tuple[list[int], list[np.ndarray]]:
    """The number of entries in each row of a bucket, and the arrays of all rows one after the other."""
    rows, wide = table.column("data").to_pylist(), sum(w for _, w in kinds)
    sizes, parts, before = [len(r) // wide for r in rows], [], 0
    for k, w in kinds:
        parts.append(np.concatenate([unplaned(r, k, n, before * n, w) for r, n in zip(rows, sizes)] or [np.empty(0, k)]))
        before += w
    return sizes, parts


def answered(table: pa.Table, sizes: list[int], *columns: np.ndarray) -> pa.Table:
    """The bucket's rows with the answers to each row's entries as data: one array of bytes, or several of 8-byte items."""
    ends = np.cumsum([0, *sizes]).tolist()
    pack = (lambda a: a.tobytes()) if columns[0].itemsize == 1 else planes
    return pa.table(
        {
            "_block": table.column("_block"),
            "bucket": table.column("bucket"),
            "data": pa.array([b"".join(pack(c[a:b]) for c in columns) for a, b in zip(ends, ends[1:])], pa.binary()),
        }
    )


def answers(table: pa.Table, columns: int = 0) -> np.ndarray:
    """A block's answers in order of bucket: bytes, or rows of `columns` 8-byte integers."""
    rows = [d for _, d in sorted(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist()))]
    if not columns:
        return np.frombuffer(b"".join(rows), np.uint8)
    parts = [np.stack([unplaned(r, np.int64, n, 8 * n * i) for i in range(columns)], axis=1) for r in rows if (n := len(r) // (8 * columns))]
    return np.concatenate(parts) if parts else np.empty((0, columns), np.int64)


def bundle(items: Iterable[tuple[int, bytes]]) -> bytes:
    """Numbered byte strings as one: how many there are, their numbers, their sizes, themselves."""
    numbers, parts = zip(*items)
    return b"".join([np.array([len(parts), *numbers, *map(len, parts)], "<u4").tobytes(), *parts])


def unbundle(raw: bytes) -> list[tuple[int, bytes]]:
    n = int.from_bytes(raw[:4], "little")
    numbers, sizes = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n).tolist()
    ends = np.cumsum([4 + 8 * n, *sizes]).tolist()
    return [(k, raw[a:b]) for k, a, b in zip(numbers, ends, ends[1:])]


def rows_of(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    """Rows (_block, bucket, data) as a table."""
    block, bucket, data = zip(*rows) if (rows := list(rows)) else ((), (), ())
    return pa.table({"_block": pa.array(block, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def columns_of(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("_block", "bucket", "data"))))


class Exchange:
    """The way of blocks' rows to so many buckets, and of the answers back."""

    def __init__(self, buckets: int, fan: int | None = None):
        self.fan = fan or FAN
        self.width = -(-buckets // self.fan)  # buckets in a range; 1: rows go straight to their buckets

    def sent(self, ask: Callable) -> Callable:
        """The function of a block that gives its rows, with the rows of a range of buckets in one."""
        if self.width == 1:
            return ask

        @wraps(ask)
        def run(*tables):
            held: dict[tuple[int, int], list] = {}
            for block, bucket, data in columns_of(ask(*tables)):
                held.setdefault((block, bucket // self.width), []).append((bucket, data))
            return rows_of((*at, bundle(items)) for at, items in held.items())

        return run

    def replies(self, rows: DataFrame, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """The answers that run gives to each bucket's rows, in their order, brought back to the blocks."""
        if self.width == 1:
            return rows.groupBy("bucket").applyInArrow(lean(run), ASKED)

        def to_buckets(table):
            held: dict[int, list] = {}
            for block, _, data in columns_of(table):
                for bucket, part in unbundle(data):
                    held.setdefault(bucket, []).append((block, part))
            group = table.column("_block")[0].as_py() // self.fan
            return rows_of((group, bucket, bundle(items)) for bucket, items in held.items())

        def answer(table):
            asked = [(group, bucket, unbundle(data)) for group, bucket, data in columns_of(table)]
            found = iter(run(rows_of((block, bucket, part) for _, bucket, items in asked for block, part in items)).column("data").to_pylist())
            return rows_of((group, bucket, bundle([(block, next(found)) for block, _ in items])) for group, bucket, items in asked)

        def to_blocks(table):
            held: dict[int, list] = {}
            for _, bucket, data in columns_of(table):
                for block, part in unbundle(data):
                    held.setdefault(block, []).append((bucket, part))
            at = table.column("bucket")[0].as_py() // self.width
            return rows_of((block, at, bundle(items)) for block, items in held.items())

        there = rows.groupBy(F.floor(F.col("_block") / self.fan), "bucket").applyInArrow(lean(to_buckets), ASKED)
        back = there.groupBy("bucket").applyInArrow(lean(answer), ASKED)
        return back.groupBy("_block", F.floor(F.col("bucket") / self.width)).applyInArrow(lean(to_blocks), ASKED)

    def received(self, table: pa.Table) -> pa.Table:
        """A block's answers, one row a bucket."""
        if self.width == 1:
            return table
        return rows_of((block, bucket, part) for block, _, data in columns_of(table) for bucket, part in unbundle(data))
