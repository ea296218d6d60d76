"""Language-model scoring with a weighted backoff automaton over words.

The smoothed n-grams of the training documents are the automaton's states.  A state (the last words read) has
an arc for every word seen after it, weighing log10 of ((count - discount) + discount * kinds * p of the word one state shorter) /
state count, and a failure arc to the state one word shorter, weighing log10 of discount * kinds / state count; the empty state
has an arc for every word, of its add-`delta` share, unknown words included.  A text is read once from left to right: its state
is carried from word to word, failure arcs are taken until the state has an arc for the word, and the weights are summed.

Counts cover all training documents.  The automaton is never gathered: each block of documents asks for the
arcs and states that its texts meet (see blocks.py), one bucket of states at a time counts them over
all blocks, and the block's texts then run through the answered part.  A state that more than one
training token in a thousand leads to is split over several buckets by the next word, and its
parts are added up by those who ask.

Words and states are told apart by 64-bit hashes, a state's arcs by 56 bits of theirs.

Rows: null text is empty; an empty text is its end token alone.  A null doc_id counts as held out of nothing
(training).  Repeated rows are counted as often as they stand.  An empty table gives an empty
result; with no training document every count is zero.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .blocks import ASKED, Exchange, bucket_of, in_blocks, lean, planes, unplaned, utf8
from .common import stash

END = b""  # no word is empty
KEPT = 400_000
STRETCH = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
SEED = 11


def held_out(doc_id: int | None, modulus: int) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % modulus == 0


def words_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_counts(docs: DataFrame, modulus: int) -> DataFrame:
    """(word, n): hashes and counts of the training tokens."""

    def run(batches):
        held: Counter = Counter()

        def out():
            h = np.array([xxh64_intdigest(w, SEED) for w in held], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(i, modulus):
                    held.update(words_of(t))
                    if len(held) > KEPT:
                        yield out()
                        held.clear()
        yield out()

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Level:
    """The n-grams of one length that a block's texts hold: arcs (a gram's last word) grouped by bucket and state (what stands before it)."""

    def __init__(self, states: np.ndarray, of: np.ndarray, arcs: np.ndarray, counts: np.ndarray, bucket: np.ndarray, probes, first: int):
        by_hash = np.argsort(states, kind="stable")
        rank = np.empty(len(states), np.int64)
        rank[by_hash] = np.arange(len(states))
        code = bucket * len(states) + rank[of]
        # grams as they are sent: by their hashes, so that the order of the block's rows, which another reading may change, says nothing
        self.order = np.lexsort((arcs, code))
        every = np.unique(np.append(code, probes[0] * len(states) + rank[probes[1]]))
        self.sizes = np.bincount(np.searchsorted(every, code), minlength=len(every))  # arcs in each group
        self.bucket, self.state = every // max(len(states), 1) + first, by_hash[every % max(len(states), 1)]
        self.states, self.of, self.arcs, self.counts = states, of, arcs, counts

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each bucket's groups start and end, and its arcs."""
        groups = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-2))
        return groups, np.append(0, np.cumsum(self.sizes))[groups]

    def rows(self):
        """(bucket, data) to send: states, arcs in each, arcs (56 bits of their hash), counts."""
        groups, arcs = self.cuts()
        for g, h, i, j in zip(groups, groups[1:], arcs, arcs[1:]):
            mine = self.order[i:j]
            yield int(self.bucket[g]), packed((self.states[self.state[g:h]], 8), (self.sizes[g:h], 4), (self.arcs[mine], 7), (self.counts[mine], 6))

    def read(self, replies: dict[int, bytes]) -> None:
        """The answers: total and kinds of each state, count of each gram."""
        self.held, self.kinds, self.seen = (np.zeros(n, np.int64) for n in (len(self.states), len(self.states), len(self.of)))
        groups, arcs = self.cuts()
        for g, h, i, j in zip(groups, groups[1:], arcs, arcs[1:]):
            held, kinds, seen = unpacked(replies[int(self.bucket[g])], 8, 8, 8)
            np.add.at(self.held, self.state[g:h], held)
            np.add.at(self.kinds, self.state[g:h], kinds)
            self.seen[self.order[i:j]] = seen


def packed(*arrays: tuple[np.ndarray, int]) -> bytes:
    """Arrays of 8-byte items with the bytes to keep of each, in byte planes, compressed."""
    raw = b"".join(planes(np.ascontiguousarray(a), w) for a, w in arrays)
    head = np.array([len(raw), *[len(a) for a, _ in arrays]], "<u4").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, *widths: int) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(data, "<u4", len(widths) + 1).tolist()
    raw, at, out = pa.decompress(data[4 * len(widths) + 4 :], size, codec="zstd", asbytes=True), 0, []
    for n, w in zip(lengths, widths):
        out.append(unplaned(raw, np.int64, n, at, w))
        at += n * w
    return out


class Texts:
    """A block's texts as numbers of its words, and its n-grams by length."""

    def __init__(self, table: pa.Table, modulus: int, order: int, buckets: int, hot: dict[int, int]):
        ids = table.column("doc_id").to_pylist()
        met: defaultdict[bytes, int] = defaultdict()
        met.default_factory = met.__len__
        parts, sizes = [], []
        for t in utf8(table):
            w = [*t.lower().split(), END]
            sizes.append(len(w))
            parts.append(np.fromiter(map(met.__getitem__, w), np.int32, len(w)))
        self.ids, self.out = ids, np.array([held_out(i, modulus) for i in ids], bool)
        self.sizes = np.array(sizes, np.int64)
        self.word = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        train = np.repeat(~self.out, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        h = np.array([xxh64_intdigest(w, SEED) for w in met], np.uint64)
        self.order, self.n = order, len(h)
        counts = np.bincount(self.word, train, self.n).astype(np.int64)
        nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.levels = [Level(np.ones(1, np.uint64), np.zeros(self.n, np.int64), h, counts, bucket_of(h, buckets), nothing, 0)]
        # of each level: a gram's last word, and the number of the gram one word shorter (its last words) at the level below
        self.last, self.shorter = [np.arange(self.n)], [np.zeros(self.n, np.int64)]
        hashes, gram = h, self.word
        place = np.arange(len(self.word)) - np.repeat(self.starts, self.sizes)
        for k in range(2, order + 1):
            # the state past the grams is the beginning of a text, of one word's length; at higher levels it stands for no state
            before = np.full(len(self.word), len(hashes), np.int64)
            before[1:] = gram[:-1]
            before[place < max(k - 2, 1)] = len(hashes)
            states = np.append(mix(hashes, np.full(1, k, np.uint64)), np.full(1, k, np.uint64) * MIX)
            below = gram
            grams, where, gram = np.unique(before * self.n + self.word, return_index=True, return_inverse=True)
            counts = np.bincount(gram, train, len(grams)).astype(np.int64)
            of, w = grams // self.n, grams % self.n
            hashes = mix(states[of], h[w])
            at = bucket_of(states, buckets)
            bucket, probes = at[of], nothing
            if k == 2 and hot:
                parts_of = np.ones(self.n + 1, np.int64)
                parts_of[:-1] = [hot.get(x, 1) for x in h.view(np.int64).tolist()]
                bucket = (bucket + (hashes >> np.uint64(40)).astype(np.int64) % parts_of[of]) % buckets
                split = np.flatnonzero((parts_of > 1) & (np.bincount(of, minlength=self.n + 1) > 0))
                probe = np.repeat(split, parts_of[split])
                nth = np.arange(len(probe)) - np.repeat(np.cumsum(parts_of[split]) - parts_of[split], parts_of[split])
                probes = ((at[probe] + nth) % buckets, probe)
            self.levels.append(Level(states, of, hashes, counts, bucket, probes, (k - 1) * buckets))
            self.last.append(w)
            self.shorter.append(below[where])

    def rows(self, block: int) -> pa.Table:
        rows = [r for level in self.levels for r in level.rows()]
        return pa.table(
            {
                "_block": pa.array(np.full(len(rows), block, np.int32)),
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "data": pa.array([r[1] for r in rows], pa.binary()),
            }
        )


class Automaton:
    """The part of the automaton that a block's texts meet.

    State 0 is the empty one; then, level by level, every state that training tokens have followed.  arcs finds the arc of
    (state, word); an arc has a weight and the state it leads to; a state has a failure arc with its weight.
    """

    def __init__(self, t: Texts, total: int, kinds: int, delta: float, discount: float):
        self.n, self.order = max(t.n, 1), t.order
        root = t.levels[0]
        p = (root.seen + delta) / (total + delta * (kinds + 1))
        self.base, self.known = np.log10(p), root.seen > 0
        for level in t.levels[2:]:
            level.held[-1] = 0
        live = [level.held > 0 for level in t.levels]
        number, ends = [np.zeros(1, np.int64)], 1
        for alive in live[1:]:
            number.append(ends + np.cumsum(alive) - 1)
            ends += int(alive.sum())
        # the state to be in for a context of each level: its own, or the one of its last words
        here = [np.zeros(1, np.int64)]
        for k in range(1, t.order):
            below = np.append(here[k - 1][t.shorter[k - 1]] if k > 1 else np.zeros(t.n, np.int64), here[k - 1][-1])
            here.append(np.where(live[k], number[k], below))
        fail, back = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, weights, goto = [], [], []
        for k, level in enumerate(t.levels):
            if k:
                alive = live[k]
                below = np.append(here[k - 1][t.shorter[k - 1]] if k > 1 else np.zeros(t.n, np.int64), here[k - 1][-1])
                fail.append(below[alive])
                back.append(np.log10(discount * level.kinds[alive] / level.held[alive]))
                share = discount * level.kinds[level.of] * p[t.shorter[k]]
                p = np.where(alive[level.of], (np.maximum(level.seen - discount, 0) + share) / np.maximum(level.held[level.of], 1), p[t.shorter[k]])
            arc = np.flatnonzero((level.seen > 0) & live[k][level.of]) if k else np.arange(t.n)
            keys.append(number[k][level.of[arc]] * self.n + t.last[k][arc])
            weights.append(np.log10(p[arc]))
            # after a gram of the longest kind its last words are the context
            goto.append(here[k + 1][arc] if k + 1 < t.order else here[k][t.shorter[k][arc]])
        self.fail, self.back = np.concatenate(fail), np.concatenate(back)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys, self.weight, self.goto = key[order], np.concatenate(weights)[order], np.concatenate(goto)[order]
        self.start = int(here[-1][-1])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, log10 probability) of reading one word in each state."""
        state, p, lost = state.copy(), np.zeros(len(state)), np.arange(len(state))
        arc, last = np.empty(len(state), np.int64), len(self.keys) - 1
        while len(lost):
            key = state[lost] * self.n + word[lost]
            at = np.searchsorted(self.keys, key)
            arc[lost] = at
            lost = lost[self.keys[np.minimum(at, last)] != key]
            p[lost] += self.back[state[lost]]
            state[lost] = self.fail[state[lost]]
        return self.goto[arc], p + self.weight[arc]

    def read(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, read from left to right, many in step.

        A long text is read in stretches of STRETCH words.  A state is told by the last order - 1 words, so a stretch that goes on in a
        text finds the state that the one before it ends in by reading that many words from the empty state.
        """
        parts = np.maximum(-(-sizes // STRETCH), 1)
        text = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, length = starts[text] + nth * STRETCH, np.minimum(sizes[text] - nth * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        text, nth, start, length = text[order], nth[order], start[order], length[order]
        state = np.full(len(text), self.start)
        later = np.flatnonzero(nth > 0)
        state[later] = 0
        for back in range(self.order - 1, 0, -1):
            state[later], _ = self.step(state[later], words[start[later] - back])
        total = np.zeros(len(text))
        for t in range(int(length.max(initial=0))):
            a = int(np.searchsorted(-length, -t, "left"))
            state[:a], p = self.step(state[:a], words[start[:a] + t])
            total[:a] += p
        return np.bincount(text, total, len(sizes))


def mix(a: np.ndarray, b) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * MIX + b * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def count_bucket(table: pa.Table) -> pa.Table:
    """One bucket's answers to each row: total count and kinds of next words of its states, count of its arcs, over all blocks."""
    found = [unpacked(d, 8, 4, 7, 6) for d in table.column("data").to_pylist()]
    states, sizes, arcs, counts = (np.concatenate([f[i] for f in found]) for i in range(4))
    groups, lengths = [len(f[0]) for f in found], [len(f[2]) for f in found]
    kinds, at = np.unique(states, return_inverse=True)
    of = np.repeat(at, sizes)
    order = np.lexsort((arcs, of))
    new = np.flatnonzero((np.diff(arcs[order], prepend=-1) != 0) | (np.diff(of[order], prepend=-1) != 0))
    total = np.add.reduceat(counts[order], new) if len(new) else counts
    back = np.empty(len(arcs), np.int64)
    back[order] = np.repeat(total, np.diff(np.append(new, len(arcs))))
    held, after = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    np.add.at(held, of[order[new]], total)
    np.add.at(after, of[order[new]], total > 0)
    g, a = np.append(0, np.cumsum(groups)).tolist(), np.append(0, np.cumsum(lengths)).tolist()
    held, after = held[at], after[at]
    rows = [packed((held[i:j], 8), (after[i:j], 8), (back[x:y], 8)) for i, j, x, y in zip(g, g[1:], a, a[1:])]
    return pa.table({"_block": table.column("_block"), "bucket": table.column("bucket"), "data": pa.array(rows, pa.binary())})


def score(docs: DataFrame, order: int = 2, modulus: int = 10, delta: float = 0.1, discount: float = 0.75) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = stash(word_counts(docs, modulus))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own, n_blocks = in_blocks(docs)
    buckets, way = n_blocks, Exchange(order * n_blocks)
    often = words.where(F.col("n") * 1000 > total).collect()  # fewer than a thousand
    hot = {r["word"]: min(buckets, 1 + int(4 * buckets * r["n"] / total)) for r in often}

    def ask(key, table):
        return Texts(table, modulus, order, buckets, hot).rows(key[0].as_py())

    def settle(key, table, replies):
        t = Texts(table, modulus, order, buckets, hot)
        replies = way.received(replies)
        of = dict(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist()))
        for level in t.levels:
            level.read(of)
        del of
        a = Automaton(t, total, kinds, delta, discount)
        doc = np.repeat(np.arange(len(t.sizes)), t.sizes)
        sums = [np.bincount(doc, x[t.word], len(t.sizes)) for x in (a.known, a.base)] + [a.read(t.word, t.starts, t.sizes)]
        return pa.table(
            {
                "doc_id": pa.array(t.ids, pa.int64()),
                "held_out": pa.array(t.out),
                "n_tokens": pa.array(t.sizes),
                "n_known": pa.array(sums[0].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(t.sizes), total, np.int64)),
                "base_score": pa.array(sums[1]),
                "score": pa.array(sums[2]),
            }
        )

    counted = way.replies(own.groupBy("_block").applyInArrow(lean(way.sent(ask)), ASKED), count_bucket)
    return (
        own.groupBy("_block")
        .cogroup(counted.groupBy("_block"))
        .applyInArrow(lean(settle), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
