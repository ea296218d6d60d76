"""Op 12: the pieces against the tokenizers library, the packing against exhaustive search and bounds."""

import random
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from driftwell.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def counted(lengths, capacity):
    return np.bincount(np.array(lengths, int), minlength=capacity + 1).astype(np.int64)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every set for the longest piece left."""

    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        first, best = left[0], len(left)

        def fill(at, room, inside):
            nonlocal best
            rest = list(left[1:])
            for x in inside:
                rest.remove(x)
            best = min(best, 1 + least(tuple(rest)))
            used = None
            for k in range(at, len(left)):
                if left[k] <= room and left[k] != used:
                    used = left[k]
                    fill(k + 1, room - left[k], [*inside, left[k]])

        fill(1, capacity - first, [])
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def check(lengths, capacity):
    """The plan's number of sequences, after holding every piece's place against every other's."""
    plan = packing.plan(counted(lengths, capacity), capacity)
    seen = Counter()
    length, number = np.array(sorted(lengths), np.int64), []
    for s in sorted(lengths):
        number.append(seen[s])
        seen[s] += 1
    sequence, offset = packing.place(plan.rows, length, np.array(number, np.int64))
    by = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        by.setdefault(s, []).append((o, n))
    assert sorted(by) == list(range(plan.sequences))
    for inside in by.values():
        at = 0
        for o, n in sorted(inside):
            assert o == at
            at += n
        assert at <= capacity
    return plan.sequences


@pytest.mark.parametrize("capacity, seed", [(c, s) for c in (10, 20, 37) for s in range(40)])
def test_reduction_keeps_the_optimum(capacity, seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 12))]
    fixed, rest = packing.reduce_by_dominance(counted(lengths, capacity), capacity)
    left = [s for s, k in enumerate(rest.tolist()) for _ in range(k)]
    for _, inside in fixed:
        assert sum(s * k for s, k in inside) <= capacity
    assert sum(t for t, _ in fixed) + fewest(left, capacity) == fewest(lengths, capacity)
    assert packing.lower_bound(counted(lengths, capacity), capacity) <= fewest(lengths, capacity) <= check(lengths, capacity)


def plain_best_fit(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_in_groups_is_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 65), rng.choice([3, 17, 30])]) for _ in range(rng.randrange(1, 200))]
    got = [64 - sum(s * k for s, k in inside) for times, inside in packing.best_fit(counted(lengths, 64), 64) for _ in range(times)]
    assert sorted(got) == plain_best_fit(lengths, 64)


def test_many_pieces_come_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(np.exp(rng.normal(6, 1, 50_000)).astype(int) + 1, 4096)
    count = counted(lengths, 4096)
    n = packing.plan(count * 1_000_000, 4096).sequences
    assert packing.lower_bound(count * 1_000_000, 4096) <= n <= 1.001 * packing.lower_bound(count * 1_000_000, 4096)
    assert check(lengths.tolist(), 4096) <= 1.001 * packing.lower_bound(count, 4096)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "Two", "straße", "zzyx", "<s>"]) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    out = list(enumerate(texts)) + [(500 + i, "same text") for i in range(80)] + [(900, None), (901, ""), (None, "x"), (None, "x"), (3, texts[3]), (3, texts[3])]
    return out + [(902, "word " * 3000)]


def test_packed_documents(spark, rows):
    capacity = 64
    docs = spark.createDataFrame([(*r, 1, "o") for r in rows], "doc_id long, text string, length int, offset string").repartition(4)
    got = packing.packed_documents(docs, PATH, capacity).collect()
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        cut = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        want += [(i, k, k * capacity, len(c), crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        at = 0
        for o, n in sorted(inside):
            assert o == at
            at += n
        assert at <= capacity
    count = counted([r.length for r in got], capacity)
    assert len(by) <= packing.lower_bound(count, capacity) + 1


def test_sequences_hold_their_pieces_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.sequences(docs, PATH, 64).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 and len(r["doc_ids"]) == len(r["lengths"]) for r in got)
    ends = sum(r["ids"].count(1) for r in got)
    tok = tokenizers.Tokenizer.from_file(PATH)
    assert sum(len(r["ids"]) for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows) and ends >= len(rows)


def test_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
