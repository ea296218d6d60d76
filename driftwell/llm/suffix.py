"""Suffix-array deduplication: bytes covered by a 50-byte string that also starts in an earlier document go.

Suffixes are sorted to a depth of `length` bytes, one bucket at a time, and told apart by a cover of samples whose ranks
are worked out first.  A cover by residues modulo v, of which every two suffixes share a sampled position within v,
takes a fifth of all positions at this depth; here the cover is chosen by content instead (the least of the 27 hashes
of 24 bytes inside a window), so equal windows hold their sample at equal offsets and a fourteenth of the positions does.

1. Cover.  The windows (string starts) between two changes of sample form a run.  Each block of documents sends its
   samples' hashes; a bucket of samples answers which of them other blocks hold as well.  A run whose sample is alone
   in the whole corpus is settled: equal windows would hold equal samples.  Hashes only ever let too much through.
2. Suffixes.  The other runs' texts, each once a block with its first document, go to their sample's bucket.  There the
   samples' suffixes are sorted by their bytes, with the common prefix of neighbours, and so is what stands before them,
   read backwards.  A window that starts o bytes before its sample then has its rank at once: the class of its sample
   to depth length - o and the class of the o bytes before it.  Windows with both in common are equal byte for byte, however
   long the ties; the least doc_id of each class decides.  The answer is one bit a window.

A sample with more than HOT different runs (a phrase all documents share) is dealt out window by window, by hashes of the
whole windows, each once a block, so no bucket grows with a hot phrase but by an entry a block.

Rows: null text is empty; texts shorter than `length` keep all bytes.  Rows that repeat a doc_id are the
same document: they don't remove each other's bytes.  A null doc_id comes after all others, and all nulls are one document.
An empty table gives an empty result.  Columns that start with an underscore and `data` or `bucket` are fine
in the input: only doc_id and text are read.  `length` is from 24 to 86 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ASKED, Exchange, answered, answers, asked, bucket_of, gathered, in_blocks, lean, planes, unplaned, utf8

GRAM = 24
CHUNK = 65_000
HOT = 4096
LAST = np.iinfo(np.int64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


BASE = 0xD6E8FEB86659FD93
POWERS = np.cumprod(np.full(CHUNK + 256, BASE, np.uint64)) * np.uint64(pow(BASE, -1, 1 << 64))
INVERSE = np.cumprod(np.full(CHUNK + 256, pow(BASE, -1, 1 << 64), np.uint64)) * np.uint64(BASE)
TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Block:
    """A block's documents in order of doc_id, one byte apart, and its runs of windows."""

    def __init__(self, table: pa.Table, length: int):
        ids = np.array([LAST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        texts = utf8(table)
        self.order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
        self.length, self.ids = length, ids[self.order]
        self.texts = [texts[i] for i in self.order]
        self.data = np.frombuffer(b"\n".join(self.texts) + bytes(length + 256), np.uint8)
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.find_runs()
        first, which = self.kinds_of_runs()
        by_key = np.argsort(self.key[first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_key] = np.arange(len(first))
        self.kind_of, self.first = place[which], first[by_key]  # of each run; the first run of each kind
        self.kind_doc = self.doc[self.first]
        # distinct samples, in order, by 48 bits of their hash
        self.codes, self.code_of, self.n_kinds = np.unique(
            self.key[self.first] >> np.uint64(16), return_inverse=True, return_counts=True
        )

    def kinds_of_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The first run of each kind (equal bytes and shape) and the kind of each run; bytes are compared, not hashes alone."""
        _, first, which = np.unique(self.klass, return_index=True, return_inverse=True)
        again = np.flatnonzero(first[which] != np.arange(len(which)))
        wide, unlike = np.arange(2 * self.length - GRAM), []
        for i in range(0, len(again), 16_384):
            part = again[i : i + 16_384]
            one = first[which[part]]
            differ = (self.data[self.pos[part][:, None] + wide] != self.data[self.pos[one][:, None] + wide]) & (
                wide < self.span[part][:, None] + self.length
            )
            unlike.append(part[differ.any(1) | (self.span[part] != self.span[one]) | (self.off[part] != self.off[one])])
        odd = np.concatenate(unlike) if unlike else again
        which[odd] = len(first) + np.arange(len(odd))
        return np.append(first, odd), which

    def find_runs(self) -> None:
        """pos (first window), span (windows - 1), off (from there to the sample), key, klass, doc of each run, in order of position."""
        found = []
        n, length, width = len(self.data) - self.length - 256, self.length, self.length - GRAM + 1
        for c in range(0, max(n - length + 1, 0), CHUNK):
            size = min(CHUNK, n - length + 1 - c)
            valid = np.zeros(size, bool)
            lo = max(0, np.searchsorted(self.starts, c, "right") - 1)
            hi = np.searchsorted(self.starts, c + size, "left")
            for s, k in zip(self.starts[lo:hi].tolist(), self.sizes[lo:hi].tolist()):
                valid[max(s - c, 0) : max(s + k - length + 1 - c, 0)] = True
            live = np.flatnonzero(valid)
            if not len(live):
                continue
            part = self.data[c : c + size + length + 32]
            words = np.empty(len(part) - 8, np.uint64)
            raw = part.tobytes()
            for o in range(8):
                w = np.frombuffer(raw, "<u8", (len(raw) - o) // 8, o)
                words[o::8] = w[: len(words[o::8])]
            h = (words[:-16] * np.uint64(0x165667B19E3779F9)) ^ (mixed(words[8:-8]) * np.uint64(0xA0761D6478BD642F))
            h = mixed((h ^ (h >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB) + mixed(words[16:] + np.uint64(1)))[: size + width - 1]
            low = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(h), dtype=np.uint64)
            step = 1
            while 2 * step <= width:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
            at = (low[live] & np.uint64(0xFFFF)).astype(np.int64)
            cut = np.flatnonzero((at[1:] != at[:-1]) | (live[1:] != live[:-1] + 1)) + 1
            first, last = live[np.r_[0, cut]], live[np.r_[cut - 1, len(live) - 1]]
            at = at[np.r_[0, cut]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[part] * POWERS[: len(part)])])
            text = (sums[last + length] - sums[first]) * INVERSE[first]
            key = mixed(h[at] + np.uint64(1))  # least hashes are small: spread them evenly again
            shape = ((at - first) << 8 | (last - first)).astype(np.uint64)
            found.append((first + c, last - first, at - first, key, mixed(mixed(text + shape * np.uint64(BASE)) ^ key)))
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.pos, self.span, self.off, self.key, self.klass = (
            np.concatenate([f[i] for f in found]) if found else np.empty(0, k) for i, k in enumerate(kinds)
        )
        self.at = np.searchsorted(self.starts, self.pos, "right") - 1
        self.doc = self.ids[self.at]

    def entries(self, status: np.ndarray, buckets: int):
        """What is asked in step 2, by the answers of step 1 (0: alone, 1: shared, 2: hot) to the distinct samples.

        Runs of kinds that need it, then distinct windows of hot kinds: (place of the first window, bytes before the sample,
        bytes from it on, document, bucket), and for the hot ones (kind, which of its windows, number of the distinct window).
        """
        state = status[self.code_of]
        asking = np.flatnonzero((state == 1) | ((state == 0) & (self.n_kinds[self.code_of] > 1)))
        run = self.first[asking]
        spread = bucket_of(self.key[run], buckets)
        hot = np.flatnonzero(state == 2)
        kind = np.repeat(hot, self.span[self.first[hot]] + 1)
        nth = np.arange(len(kind)) - np.repeat(np.cumsum(self.span[self.first[hot]] + 1) - self.span[self.first[hot]] - 1, self.span[self.first[hot]] + 1)
        p = self.pos[self.first[kind]] + nth
        text = np.ascontiguousarray(self.data[p[:, None] + np.arange(self.length)])
        if len(text):
            _, one, number = np.unique(text.view(f"V{self.length}").ravel(), return_index=True, return_inverse=True)
        else:
            one = number = np.empty(0, np.int64)
        doc = np.full(len(one), LAST)
        np.minimum.at(doc, number, self.kind_doc[kind])
        before = (self.off[self.first[kind]] - nth)[one]
        h = mixed((TABLE[text[one]] * POWERS[: self.length]).sum(1, dtype=np.uint64))
        return (
            (
                np.append(self.pos[run], p[one]),
                np.append(self.off[run], before),
                np.append(self.span[run] + self.length - self.off[run], self.length - before),
                np.append(self.kind_doc[asking], doc),
                np.append(spread, bucket_of(h, buckets)),
            ),
            asking,
            (kind, nth, number),
        )

    def removed(self, starts: np.ndarray, ends: np.ndarray):
        """Maximal removed stretches from overlapping ones: (start, end), by position."""
        order = np.argsort(starts, kind="stable")
        s, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
        new = np.ones(len(s), bool)
        new[1:] = s[1:] > reach[:-1]
        heads = np.flatnonzero(new)
        return s[heads], reach[np.r_[heads[1:] - 1, len(s) - 1]] if len(s) else reach


def sort_samples(hot: int):
    """A function that answers one bucket of samples: 0 if only one block holds it, 2 if it has more than `hot` kinds of runs, else 1."""

    def run(table):
        sizes, (code, kinds) = gathered(table, [(np.uint64, 6), (np.uint64, 2)])
        _, at, blocks = np.unique(code, return_inverse=True, return_counts=True)
        total = np.bincount(at, kinds.astype(np.float64))
        return answered(table, sizes, np.where(total > hot, 2, np.where(blocks > 1, 1, 0)).astype(np.uint8)[at])

    return run


def texts_of_runs(b: Block, block: int, entries) -> pa.Table:
    """Rows (_block, bucket, data) of a block's entries in order of bucket: the text around each sample, compressed."""
    pos, before, after, doc, bucket = (a[np.argsort(entries[-1], kind="stable")] for a in entries)
    wide, deep = b.length - GRAM, b.length
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    rows = []
    for i, j in zip(cuts, cuts[1:]):
        at = (pos + before)[i:j, None]
        left = b.data[np.maximum(at - 1 - np.arange(wide), 0)] * (np.arange(wide) < before[i:j, None])
        right = b.data[at + np.arange(deep)] * (np.arange(deep) < after[i:j, None])
        raw = left.tobytes() + right.tobytes() + before[i:j].astype(np.uint8).tobytes() + after[i:j].astype(np.uint8).tobytes() + planes(doc[i:j])
        rows.append(int(j - i).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True))
    return pa.table(
        {
            "_block": pa.array(np.full(len(rows), block, np.int32)),
            "bucket": pa.array(bucket[cuts[:-1]].astype(np.int32)),
            "data": pa.array(rows, pa.binary()),
        }
    )


def ranked(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of bytes, and how many bytes each row in order shares with the one before it (none: -1)."""
    n, wide = text.shape
    padded = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = text
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    shared = np.full(n, -1, np.int64)
    for i in range(1, n, 65_536):
        a, b = text[order[i : i + 65_536]], text[order[i - 1 : i - 1 + min(65_536, n - i)]]
        differ = a != b
        shared[i : i + len(a)] = np.where(differ.any(1), differ.argmax(1), wide)
    return order, shared


def sort_suffixes(length: int):
    """A function that sorts one bucket of entries and answers each with a bit for every window that starts in an earlier document."""
    wide = length - GRAM

    def run(table):
        rows = table.column("data").to_pylist()
        sizes = [int.from_bytes(r[:4], "little") for r in rows]
        parts = [[], [], [], [], []]
        for i, n in enumerate(sizes):
            raw = pa.decompress(rows[i][4:], n * (wide + length + 10), codec="zstd", asbytes=True)
            rows[i], at = None, 0
            for part, w in zip(parts, (wide, length, 1, 1)):
                part.append(np.frombuffer(raw, np.uint8, n * w, at).reshape(n, w))
                at += n * w
            parts[4].append(unplaned(raw, np.int64, n, at))
        left, right, before, after = (np.concatenate(p) for p in parts[:4])
        before, after, doc = before.ravel().astype(np.int64), after.ravel().astype(np.int64), np.concatenate(parts[4])
        (by_right, right_lcp), (by_left, left_lcp) = ranked(right), ranked(left)
        n = len(doc)
        bits, right_class, left_class = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        for o in range(wide + 1):
            has = np.flatnonzero((before >= o) & (after >= length - o))
            if len(has) < 2:
                continue
            right_class[by_right] = np.cumsum(right_lcp < length - o)
            left_class[by_left] = np.cumsum(left_lcp < o)
            both = right_class[has] * (n + 1) + left_class[has]
            order = np.argsort(both, kind="stable")
            new = np.flatnonzero(np.diff(both[order], prepend=-1))
            least = np.minimum.reduceat(doc[has[order]], new)
            earlier = np.repeat(least, np.diff(np.append(new, len(order)))) < doc[has[order]]
            found = has[order[earlier]]
            bits[found] |= np.left_shift(1, before[found] - o)
        return answered(table, sizes, bits)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, text (kept bytes; broken characters left out).

    Columns of docs named in `carry` come along as fields of a struct `carried`.
    """
    if not GRAM <= length <= GRAM + 62:
        raise ValueError(f"length is from {GRAM} to {GRAM + 62}")
    carried = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    own, n = in_blocks(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    )
    buckets, way = n, Exchange(n)

    def ask_samples(key, table):
        b = Block(table, length)
        kinds = np.minimum(b.n_kinds, 65_535).astype(np.uint64)
        return asked(key[0].as_py(), bucket_of(b.codes << np.uint64(16), buckets), (b.codes, 6), (kinds, 2))

    def ask_suffixes(key, table, replies):
        b = Block(table, length)
        entries, _, _ = b.entries(answers(way.received(replies)), buckets)
        return texts_of_runs(b, key[0].as_py(), entries)

    def settle(key, table, replies):
        b = Block(table, length)
        step = replies.column("step").to_numpy()
        entries, asking, (kind, nth, number) = b.entries(answers(way.received(replies.filter(pa.array(step == 1)))), buckets)
        got = np.empty(len(entries[0]), np.int64)
        got[np.argsort(entries[-1], kind="stable")] = answers(way.received(replies.filter(pa.array(step == 2))), 1)[:, 0]
        bits = np.zeros(len(b.first), np.int64)
        bits[asking] = got[: len(asking)]
        known = got[len(asking) :][number] | (entries[3][len(asking) :][number] < b.kind_doc[kind])
        np.bitwise_or.at(bits, kind, np.left_shift(known, nth))
        whole = (b.doc > b.kind_doc[b.kind_of]) | (bits[b.kind_of] == np.left_shift(1, b.span + 1) - 1)
        partly = np.flatnonzero(~whole & (bits[b.kind_of] != 0))
        each = bits[b.kind_of[partly]]
        pos = np.concatenate([b.pos[partly[each >> w & 1 == 1]] + w for w in range(length - GRAM + 1)])
        s, e = b.removed(np.r_[pos, b.pos[whole]], np.r_[pos + length, (b.pos + b.span)[whole] + length])
        at = np.searchsorted(b.starts, s, "right") - 1
        cuts = np.searchsorted(at, np.arange(len(b.texts) + 1)).tolist()
        s, e = (s - b.starts[at]).tolist(), (e - b.starts[at]).tolist()
        kept, gone = [], []
        for i, t in enumerate(b.texts):
            lo, hi = cuts[i], cuts[i + 1]
            kept.append(b"".join(t[x:y] for x, y in zip([0, *e[lo:hi]], [*s[lo:hi], len(t)])) if hi > lo else t)
            gone.append((len(t) - len(kept[-1]), hi - lo))
        out = {
            "doc_id": pa.array([None if i == LAST else i for i in b.ids.tolist()], pa.int64()),
            "n_bytes": pa.array(b.sizes),
            "n_removed": pa.array([g[0] for g in gone], pa.int64()),
            "n_spans": pa.array([g[1] for g in gone], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if with_text:
            out["text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        if carry:
            out["carried"] = table.column("carried").combine_chunks().take(pa.array(b.order))
        return pa.table(out)

    samples = way.replies(own.groupBy("_block").applyInArrow(lean(way.sent(ask_samples)), ASKED), sort_samples(hot))
    runs = own.groupBy("_block").cogroup(samples.groupBy("_block")).applyInArrow(lean(way.sent(ask_suffixes)), ASKED)
    suffixes = way.replies(runs, sort_suffixes(length))
    replies = samples.withColumn("step", F.lit(1)).unionByName(suffixes.withColumn("step", F.lit(2)))
    schema = T.StructType.fromDDL(
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    )
    if carry:
        schema = schema.add(own.schema["carried"])
    return own.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(lean(settle), schema)


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows and columns of docs, with text cut down to what no earlier document holds."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, length, True, rest)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c).alias(c) for c in docs.columns])
